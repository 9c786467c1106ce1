"""Texts of pages from bytes in an unknown charset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of Hangul read in a wrong charset; two different ones tell a broken text.
BROKEN_MARKS = ("ë", "ì", "í", "ê", "Â", "Ã", "\x89", "\x8a", "\x9c")
CHARSETS = ("utf-8", "euc-kr")


def looks_broken(text: Column) -> Column:
    """Two marks or more. French has some of them in sound texts, so this asks for a look and decides nothing."""
    return sum(F.contains(text, F.lit(m)).cast("int") for m in BROKEN_MARKS) >= 2


def best_decoding(content: bytes, charsets: tuple[str, ...] = CHARSETS) -> tuple[str, str]:
    """(text, charset) of the decoding with the fewest replacement characters, the first of equals."""
    tries = [(content.decode(c, errors="replace"), c) for c in charsets]
    return min(tries, key=lambda t: t[0].count("\ufffd"))


def with_decoded(df: DataFrame, content: str = "content", text: str = "text", charsets: tuple[str, ...] = CHARSETS) -> DataFrame:
    """df with `text` and `charset` of its bytes.

    Valid UTF-8 is decoded where it is; only the rest is tried in each charset, in Python. A null is an empty text.
    """
    columns = df.columns
    read = df.withColumn("_as_is", F.coalesce(F.col(content).cast("string"), F.lit("")))
    read = read.withColumn("_sound", F.is_valid_utf8("_as_is"))
    sound = read.where("_sound").select(*columns, F.col("_as_is").alias(text), F.lit("utf-8").alias("charset"))
    rest = read.where("not _sound").select(*columns)
    # Rows in small batches, not in Arrow's of thousands: a page may be long.
    decode = F.udf(lambda x: best_decoding(bytes(x or b""), charsets), f"`{text}` string, charset string", useArrow=False)
    told = rest.withColumn("_told", decode(content)).select(*columns, f"_told.`{text}`", "_told.charset")
    return sound.unionByName(told)
