"""Routing of list items between sections by the labels inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_list, strip
from ..functions.text import _quoted
from ..rules import FRAGMENT_SIGNS, INLINE_LABELS, SENTENCE_ENDING, TRAILING_ADVERT

EDGES = r"^[ :,.;·ㆍ\[\]()\n\t]+|[ :,.;·ㆍ\[\]()\n\t]+$"
NUMBERING = r"(?:(?<=\s)|(?<=^))(?=(?:\d{1,2}\s*[.)]|[가-힣]\s*\)|[①-⑳㈀-㈎]))"


def flat(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def inline_segments(c: Column, labels: tuple[tuple[str, str], ...] = INLINE_LABELS, keep_lines: bool = False) -> Column:
    """array<struct<section, body>>: what stands before the first label, with a null section, and after each label.

    One alternation, longest label first, finds the leftmost and longest labels without overlap.
    """
    text = F.coalesce(c, F.lit("")) if keep_lines else flat(c)
    pattern = "(?i)" + "|".join(_quoted(k) for k, _ in sorted(labels, key=lambda x: -len(x[0])))
    section = F.create_map(*[F.lit(x) for k, s in labels for x in (k.lower(), s)])
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    bodies = F.split(text, pattern)
    parts = F.transform(bodies, lambda b, i: F.struct(F.when(i > 0, F.element_at(section, F.lower(F.get(found, i - 1)))).alias("section"), F.regexp_replace(b, EDGES, "").alias("body")))
    return F.filter(parts, lambda p: p["body"] != "")


def numbered_items(c: Column) -> Column:
    """Items that begin with 1. 2) or a bracketed or circled mark; none if there are fewer than two."""
    pieces = F.filter(F.transform(F.split(flat(c), NUMBERING), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: F.length(x) >= 4)
    return F.when(F.size(pieces) <= 1, F.array().cast("array<string>")).otherwise(pieces)


def sentences(c: Column) -> Column:
    """Lines, or without line feeds sentences."""
    c = F.coalesce(c, F.lit(""))
    parts = F.when(F.contains(c, F.lit("\n")), F.split(c, "\n")).otherwise(F.split(c, r"(?<=[.!?。])\s+|(?<=다\.)\s+"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def ends_sentence(c: Column) -> Column:
    return c.rlike(SENTENCE_ENDING)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def is_fragment(c: Column) -> Column:
    """A short phrase behind an advertising sign."""
    return F.substring(c, 1, 1).isin(*FRAGMENT_SIGNS) & (F.length(c) <= 15) & ~ends_sentence(c)


def is_short_header(c: Column) -> Column:
    return (c == "") | (~ends_sentence(c) & (word_count(c) < 3) & (F.length(c) < 10))


def split_advert(c: Column) -> Column:
    """struct<body, advert>: a trailing advertisement cut off; all of the text is one if fewer than four characters stay."""
    advert = F.regexp_extract(c, f"({TRAILING_ADVERT})", 1)
    body = F.regexp_replace(F.regexp_replace(c, TRAILING_ADVERT, ""), "[ ,;·ㆍ]+$", "")
    return F.struct(F.when(advert == "", c).when(F.length(body) < 4, "").otherwise(body).alias("body"), F.when(advert != "", F.regexp_replace(advert, r"^[ .]+|[ .]+$", "")).alias("advert"))


def cross_route(df: DataFrame, usage: str = "usage", cautions: str = "cautions", effects: str = "effects") -> DataFrame:
    """df with the three lists routed by inline labels, cautions split by their numbers, and fragments cleaned."""

    def routed(target: str) -> Column:
        lists = []
        for name, own in ((usage, "usage"), (cautions, "cautions"), (effects, "effects")):
            parts = F.flatten(F.transform(clean_list(F.col(name)), inline_segments))
            lists.append(F.transform(F.filter(parts, lambda p, own=own: F.coalesce(p["section"], F.lit(own)) == target), lambda p: p["body"]))
        return clean_list(F.concat(*lists))

    told = df.withColumns({"_u": routed("usage"), "_c": routed("cautions"), "_e": routed("effects")})
    split = F.flatten(F.transform("_c", lambda x: F.when(F.size(numbered_items(x)) > 0, numbered_items(x)).otherwise(F.array(x))))
    told = told.withColumn("_c", F.transform(clean_list(split), split_advert))
    adverts = F.filter(F.transform("_c", lambda p: p["advert"]), lambda x: x.isNotNull())
    moved = F.filter("_u", is_fragment)
    return told.withColumns({
        usage: clean_list(F.filter("_u", lambda x: ~is_fragment(x) & ~is_short_header(x))),
        cautions: clean_list(F.filter(F.transform("_c", lambda p: p["body"]), lambda x: ~is_short_header(x))),
        effects: clean_list(F.filter(F.concat("_e", moved, adverts), lambda x: ~is_short_header(x))),
    }).drop("_u", "_c", "_e")
