"""Order-preserving array operators; no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SENTINELS, UNKNOWN
from ..storage import saved

Unary = Callable[[Column], Column]


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bound(value: Column, use: Unary) -> Column:
    """use(value), with value worked out once however often it is used, in lambdas too: by a list of one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compact(c: Column) -> Column:
    """Matching key: lower case, without white space, dashes, punctuation and brackets."""
    return F.translate(F.lower(c), " \n\r\t-_:：.,，;；/·ㆍ[](){}", "")


def compact_query(c: Column) -> Column:
    """Matching key of catalogue lookups, which keeps brackets."""
    return F.translate(F.lower(c), " \n\r\t-_:：,/·ㆍ.;；", "")


def compact_link(c: Column) -> Column:
    """Matching key of links."""
    return F.translate(F.lower(c), " \n\r\t-_:：.,，/·ㆍ[]()", "")


def spaceless(c: Column) -> Column:
    """Matching key of de-duplication: lower case without white space."""
    return replaced(F.lower(c), [(w, "") for w in " \n\r\t"])


def ordered_distinct(items: Column, key: Unary = spaceless) -> Column:
    """Items whose key has not come before, in order, first spelling first. Items with a null or empty key go.

    For the short lists of a record: every distinct key is looked up once. For long lists, distinct_rows.
    """
    # Lambdas work out again, for each element, whatever they name but variables.
    return bound(items, lambda xs: bound(F.transform(xs, key), lambda keys: _firsts(xs, keys)))


def _firsts(items: Column, keys: Column) -> Column:
    wanted = F.filter(F.array_distinct(keys), lambda k: k.isNotNull() & (k != ""))
    return F.transform(wanted, lambda k: F.element_at(items, F.array_position(keys, k).cast("int")))


def distinct_rows(df: DataFrame, by: str, items: Column, key: Unary = spaceless) -> DataFrame:
    """(by, items) as ordered_distinct gives them, by rows: for lists of any length, with partial sums before the shuffle."""
    each = df.select(by, F.posexplode(items).alias("_pos", "_v")).withColumn("_k", key(F.col("_v"))).where("_k is not null and _k <> ''")
    first = each.groupBy(by, "_k").agg(F.min("_pos").alias("_pos"), F.min_by("_v", "_pos").alias("_v"))
    return first.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias("items"))


#: Texts of up to so many characters have their words told apart where they lie.
SHORT_TEXT = 1 << 20


def distinct_words(df: DataFrame, by: str, text: str, ends: str, key: Unary = spaceless, short: int = SHORT_TEXT) -> DataFrame:
    """(by, items) for each row of df: the words of `text` between `ends` as distinct_rows gives them, null where there are none.

    A text's words lie in its row and are told apart there, by a sort, so none is shuffled. Rows that share `by`, whose words count
    together, and texts of more than `short` characters go by rows.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"), F.max(F.length(text)).alias("_m"))
    others = saved(sizes.where((F.col("_n") > 1) | (F.col("_m") > short)).select(by), "by-rows")
    own = df.join(others, by, "left_anti").select(by, F.array_distinct(F.split(text, ends)).alias("_w"))
    own = own.withColumn("_s", F.sort_array(F.transform("_w", lambda w, i: F.struct(key(w).alias("k"), i.alias("i"), w.alias("w")))))
    first = lambda x, j: (x["k"] != "") & ((j == 0) | (F.get("_s", j - 1)["k"] != x["k"]))
    own = own.withColumn("_f", F.sort_array(F.transform(F.filter("_s", first), lambda x: F.struct(x["i"], x["w"].alias("w")))))
    told = own.select(by, F.when(F.col(by).isNotNull() & (F.size("_f") > 0), F.transform("_f", lambda x: x["w"])).alias("items"))
    rest = df.join(others, by, "left_semi")
    return told.unionByName(rest.select(by).join(distinct_rows(rest, by, F.split(text, ends), key), by, "left"))


def clean_list(items: Column) -> Column:
    """Items without blanks, nulls and sentinels, ends stripped, ordered distinct; a null list is empty."""
    stripped = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    good = F.filter(stripped, lambda x: x.isNotNull() & (x != "") & ~x.isin(*SENTINELS))
    # Most lists hold no equals, and those of one item need no keys: the key of what is left is never empty.
    several = lambda xs: bound(F.transform(xs, spaceless), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(xs), xs).otherwise(_firsts(xs, keys)))
    return bound(good, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(several(xs)))


def safe_list(items: Column) -> Column:
    """clean_list, or the one item UNKNOWN."""
    return bound(clean_list(items), lambda xs: F.when(F.size(xs) == 0, F.array(F.lit(UNKNOWN))).otherwise(xs))


def value_or_unknown(c: Column) -> Column:
    stripped = strip(c)
    return F.when(c.isNull() | (stripped == "") | stripped.isin(*SENTINELS), F.lit(UNKNOWN)).otherwise(stripped)


def known(c: Column) -> Column:
    """The stripped value, null instead of blanks and sentinels."""
    stripped = strip(c)
    return F.when((stripped != "") & ~stripped.isin(*SENTINELS), stripped)


def first_known(items: Column) -> Column:
    return F.get(clean_list(items), F.lit(0))


def joined(items: Column, by: str = "\n\n") -> Column:
    return F.array_join(clean_list(items), by)


def collapsed(items: Column) -> Column:
    """One item: the fragments joined by spaces, white space collapsed."""
    return F.array(F.regexp_replace(F.array_join(clean_list(items), " "), r"(?U)\s+", " "))


def replaced(c: Column, pairs) -> Column:
    """Plain replacements, in order."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
