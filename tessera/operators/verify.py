"""Verification of names against a catalogue: expand, look up, score, choose, sum up."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.arrays import compact_query, ordered_distinct, strip
from ..functions.text import bound, clean_query, search_hint
from ..rules import INVALID_CANDIDATES, LABELS, RuleSet
from ..storage import saved
from .lookup import of_distinct

#: What a score gains where one key holds the other.
HOLDS = 0.10
#: Rows of the index that one part of a gram holds, about.
PART_ROWS = 20_000

ENDS = r"^[ ,;:：/·ㆍ\-|()\[\]{}]+|[ ,;:：/·ㆍ\-|()\[\]{}]+$"


def invalid_candidate(c: Column, rules: RuleSet = LABELS) -> Column:
    """Too short or long, without letters, half digits, a short Latin word, a link, or with a word of running text."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    words = "|".join(sorted({w.lower() for w in INVALID_CANDIDATES}, key=len, reverse=True))
    return (
        c.isNull() | (F.length(c) <= 1) | (F.length(c) > rules.candidate_length) | ~c.rlike("[가-힣a-zA-Z]") | (digits >= F.length(c) * 0.5)
        | (c.rlike("^[a-zA-Z]{1,4}$") & ~F.lower(c).isin("peg", "ppg")) | c.rlike(r"(?i)https?://|www\.|\.com|\.co\.kr|\.kr") | F.lower(c).rlike(words)
    )


def split_by_space(c: Column) -> Column:
    """Two Latin words stay one name; three or more Latin words, or three or more plausible ones, are split."""
    return bound(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""), lambda tokens: _split_tokens(c, tokens))


def _split_tokens(c: Column, tokens: Column) -> Column:
    latin = F.size(F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z\-]+$")))
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, ENDS, ""))
    good = F.size(F.filter(plain, lambda t: F.length(t).between(2, 45) & t.rlike("[가-힣A-Za-z]")))
    n = F.size(tokens)
    whole = F.array(c)
    return F.when((n <= 1) | ((n == 2) & (latin == 2)), whole).when((latin >= 3) | ((n >= 3) & (good >= 3)), tokens).otherwise(whole)


def split_candidate(c: Column) -> Column:
    """Lines, then separators, then spaces where that is safe."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n]+|[,，、;；|·ㆍ]+"), lambda x: F.regexp_replace(strip(x), ENDS, "")), lambda x: x != "")
    pieces = F.flatten(F.transform(parts, split_by_space))
    return F.filter(F.transform(pieces, lambda x: F.regexp_replace(strip(x), ENDS, "")), lambda x: x != "")


def expand_candidates(rows: DataFrame, by: str, names: str, rules: RuleSet = LABELS) -> DataFrame:
    """(by, pos, name): all valid parts of an array of names, once each by lookup key, in order."""
    pieces = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), split_candidate))
    good = F.filter(F.transform(pieces, lambda x: search_hint(x)), lambda x: ~invalid_candidate(x, rules))
    return rows.select(by, F.posexplode(ordered_distinct(good, compact_query)).alias("pos", "name"))


def query_variants(c: Column, rules: RuleSet = LABELS) -> Column:
    """At most query_variants spellings, the likeliest first: as it is, and without dashes, commas, ppm and slashes, then the parts between slashes."""

    def spellings(base: Column) -> Column:
        parts = F.when(F.contains(base, F.lit("/")), F.split(base, "/")).otherwise(F.array().cast("array<string>"))
        ppm = F.when(base.rlike(r"(?i)\d+ppm"), F.regexp_replace(base, r"(?i)\d+ppm", ""))
        every = F.concat(F.array(base, F.replace(base, F.lit("-"), F.lit("")), F.replace(base, F.lit(","), F.lit("")), ppm, F.replace(base, F.lit("/"), F.lit(""))), parts)
        # Equal ones are cleaned once.
        return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))

    cleaned = F.transform(bound(clean_query(search_hint(c)), spellings), lambda x: clean_query(search_hint(x)))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: F.length(x) > 1)), 1, rules.query_variants)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (Ratcliff and Obershelp), as difflib defines it; 0 if their characters alone keep it under `least`."""
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y, low in zip(a, b, least):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio() if matcher.quick_ratio() >= low else 0.0)
    return pd.Series(out, dtype="float64")


def length_factor(n: Column, m: Column) -> Column:
    """What a score is multiplied by: less the more the lengths differ."""
    far = F.abs(n - m)
    return F.when(far >= 10, 0.78).when(far >= 8, 0.84).when(far >= 5, 0.90).otherwise(1.0)


def key_similarity(kx: Column, ky: Column, least: Column | None = None) -> Column:
    """The ratio of two keys, more if one holds the other, less the more their lengths differ; three decimals."""
    inside = F.when(F.contains(ky, kx) | F.contains(kx, ky), HOLDS).otherwise(0.0)
    ratio = sequence_ratio(kx, ky, F.lit(0.0) if least is None else least)
    return F.bround(F.least((ratio + inside) * length_factor(F.length(kx), F.length(ky)), F.lit(1.0)), 3)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names; else the similarity of their keys."""
    x, y = search_hint(clean_query(a)), search_hint(clean_query(b))
    kx, ky = compact_query(x), compact_query(y)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when((x == y) | (kx == ky), 1.0).otherwise(key_similarity(kx, ky))


def shared_grams(n: Column, m: Column, match: float) -> Column:
    """What two unequal keys of n and m characters must share for a score of `match`: (q, grams, apart, ratio), null if no score can reach it.

    A ratio is 2 * matched / (n + m), where the matched characters stand in the same order in both keys. The score asks for a
    number of them; all others, `apart`, are what positions can be shifted by. At least `grams` matched q-grams follow: each of the
    others parts one matched pair of neighbours. Two-grams are taken where two or more must be shared, else single characters.
    Where only the bonus of a key inside the other one reaches the threshold, all grams of the shorter key, of up to three, are shared.
    """
    least = match - 0.0005  # scores are rounded to three decimals
    factor, short, both = length_factor(n, m), F.least(n, m), n + m
    need = F.ceil(least / factor * both / 2 - 1e-9).cast("int")
    pairs, q = 3 * need - both - 1, F.least(short, F.lit(3))
    told = lambda q, grams, apart, matched: F.struct(q.cast("int").alias("q"), grams.cast("int").alias("grams"), apart.cast("int").alias("apart"), (2 * matched / both - 1e-9).alias("ratio"))
    inside = ((2 * short / both + HOLDS) * factor >= least - 1e-9) & (n != m)
    plain = F.when(pairs >= 2, told(F.lit(2), pairs, both - 2 * need, need)).otherwise(told(F.lit(1), need, both - 2 * need, need))
    return F.when(need <= short, plain).when(inside, told(q, short - q + 1, F.abs(n - m), short))


def key_grams(key: Column, q: Column) -> Column:
    """The q-grams of a key as (gram, at), from 0; none if it is shorter."""
    starts = F.when(F.length(key) >= q, F.sequence(F.lit(0), F.length(key) - q)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.substring(key, i + 1, q).alias("gram"), i.alias("at")))


def letter_counts(key: Column) -> Column:
    """How many characters of a key fall in each of 16 classes by hash, up to 15, as 16 digits of a 64-bit number."""
    classes = F.transform(key_grams(key, F.lit(1)), lambda g: F.pmod(F.xxhash64(g["gram"]), F.lit(16)))
    held = lambda i: F.least(F.size(F.filter(classes, lambda c: c == i)), F.lit(15)).cast("bigint")
    return reduce(Column.bitwiseOR, (F.shiftleft(held(i), 4 * i) for i in range(16)))


def letters_apart(x: Column, y: Column) -> Column:
    """At most as many characters as two keys have beyond the shared ones, from their letter_counts."""
    digit = lambda c, i: F.shiftright(c, 4 * i).bitwiseAND(F.lit(15))
    return reduce(Column.__add__, (F.abs(digit(x, i) - digit(y, i)) for i in range(16)))


def near_keys(asked: DataFrame, items: DataFrame, match: float, part_rows: int = PART_ROWS) -> DataFrame:
    """Distinct pairs of asked (_qk) and items (_ik, item_pos), and the ratio (least) they need: all whose score can reach `match`.

    items become an inverted index of 1-, 2- and 3-grams by length of key. Each asked key looks up each length that can match it.
    In one order of grams, rare ones first, the first gram that both share comes early: at most as many come before it as need
    not be shared. Rows of the index tell their gram's place in that order and in the key, so that pairs whose first shared gram
    comes too late, or too far away, or whose letters differ too much, are left out before they are compared. A gram of many items is dealt over parts of about
    part_rows rows. Both tables: each key once. Without items or asked keys there are no pairs.
    """
    if match <= HOLDS + 0.001:
        raise ValueError("a threshold that the bonus alone reaches leaves out no pair")
    size = F.length("_ik")
    each = items.withColumns({"m": size, "letters_i": letter_counts(F.col("_ik"))}).select("_ik", "item_pos", "m", "letters_i", F.explode(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda q: key_grams(F.col("_ik"), q)))).alias("g")).select("*", "g.*").drop("g")
    each = saved(each, "grams")
    counts = saved(each.groupBy("m", "gram").agg(F.count("*").alias("f")), "gram-counts")
    order = ("f", "gram", "at")
    index = each.join(counts, ["m", "gram"]).withColumn("rank_i", F.row_number().over(Window.partitionBy("_ik", F.length("gram")).orderBy(*order)))
    index = index.withColumn("part", F.pmod(F.xxhash64("_ik"), F.ceil(F.col("f") / part_rows)).cast("int")).withColumnRenamed("at", "at_i").drop("f")
    n = F.length("_qk")
    # a score is at most 2 * shorter / (n + m) + HOLDS, so the shorter key is at least `low` of the longer one
    low = (match - HOLDS - 0.0005) / (2 - (match - HOLDS - 0.0005))
    lengths = asked.withColumns({"n": n, "letters": letter_counts(F.col("_qk"))}).withColumn("m", F.explode(F.sequence(F.greatest(F.ceil(F.col("n") * low - 1e-9), F.lit(1)).cast("int"), F.floor(F.col("n") / low + 1e-9).cast("int"))))
    lengths = lengths.withColumn("s", shared_grams(F.col("n"), F.col("m"), match)).where("s is not null").select("_qk", "n", "m", "letters", "s.*")
    lengths = lengths.join(counts.select("m").distinct(), "m")
    looked = lengths.withColumn("g", F.explode(key_grams(F.col("_qk"), F.col("q")))).select("*", "g.*").drop("g")
    looked = looked.join(counts, ["m", "gram"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    looked = looked.withColumn("rank_q", F.row_number().over(Window.partitionBy("_qk", "m").orderBy(*order)))
    looked = looked.where("f > 0 and rank_q <= n - q + 2 - grams").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("f") / part_rows).cast("int") - 1))).drop("f")
    met = looked.join(index, ["m", "gram", "part"]).where("rank_i <= m - q + 2 - grams and abs(at_i - at) + abs((m - at_i) - (n - at)) <= apart")
    met = met.where(letters_apart(F.col("letters"), F.col("letters_i")) <= F.col("apart"))
    return met.groupBy("_qk", "_ik", "item_pos").agg(F.max("ratio").alias("least"))


def best_matches(queries: DataFrame, catalogue: DataFrame, rules: RuleSet = LABELS, names: tuple[str, ...] = ("kor_name", "eng_name", "alias")) -> DataFrame:
    """(query, matched, item_pos, score): for each distinct query the best item of the catalogue that reaches the threshold, the first of equals.

    A query that no item matches has no row. A score follows from the keys alone, so distinct keys are compared, each item key
    standing for its first item. Equal keys are joined first; the others meet those that can reach the threshold: no match is
    lost, and no cross join.
    """
    item = catalogue.select("item_pos", F.explode(F.array_distinct(F.array(*names))).alias("item_name")).where("item_name is not null and item_name <> ''")
    item = item.groupBy("item_name").agg(F.min("item_pos").alias("item_pos")).withColumn("_ik", compact_query(search_hint(clean_query(F.col("item_name"))))).where("_ik <> ''")
    item = saved(item.groupBy("_ik").agg(F.min("item_pos").alias("item_pos")), "item-keys")
    asked = queries.select("query").where("query is not null and query <> ''").distinct().withColumn("_qk", compact_query(search_hint(clean_query(F.col("query"))))).where("_qk <> ''")
    asked = saved(asked, "asked-keys")
    keys = asked.select("_qk").distinct()
    exact = keys.join(item, F.col("_qk") == F.col("_ik")).select("_qk", "item_pos", F.lit(1.0).alias("score"))
    rest = keys.join(item, F.col("_qk") == F.col("_ik"), "left_anti")
    near = near_keys(rest, item, rules.match)
    fuzzy = near.select("_qk", "item_pos", key_similarity(F.col("_qk"), F.col("_ik"), F.col("least")).alias("score")).where(F.col("score") >= rules.match)
    best = exact.unionByName(fuzzy).groupBy("_qk").agg(F.max(F.struct("score", (-F.col("item_pos")).alias("p"))).alias("b"))
    return asked.join(best, "_qk").select("query", F.lit(True).alias("matched"), (-F.col("b.p")).alias("item_pos"), F.col("b.score").alias("score"))


def match_candidates(candidates: DataFrame, catalogue: DataFrame, by: str, rules: RuleSet = LABELS) -> DataFrame:
    """candidates (by, pos, name) with query, matched, item_pos, score: the first spelling that matches strongly, else the best one.

    Each distinct name is worked out once, however many candidates have it. A null name matches nothing, as one of which no spelling is left.
    """
    rows = saved(candidates, "candidates")

    def told(names: DataFrame) -> DataFrame:
        tried = saved(names.select("text", F.posexplode(query_variants(F.col("text"), rules)).alias("v", "query")), "spellings")
        found = tried.join(best_matches(tried.select("query"), catalogue, rules), "query", "left")
        strong = F.coalesce((F.col("score") >= rules.strong_match).cast("int"), F.lit(0))
        order = Window.partitionBy("text").orderBy(F.desc(strong), F.when(strong == 1, F.col("v")), F.desc_nulls_last("score"), "v")
        best = found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("text", "query", F.coalesce("matched", F.lit(False)).alias("matched"), F.when(F.col("matched"), F.col("item_pos")).alias("item_pos"), F.coalesce("score", F.lit(0.0)).alias("score"))
        return names.join(best, "text", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))

    return of_distinct(rows, "name", told, "names").unionByName(rows.where("name is null").withColumn("matched", F.lit(False)), allowMissingColumns=True)


def summary(matches: DataFrame, by: str, name_col: str = "verified_name") -> DataFrame:
    """One row per request: counts, rate over all checked names and status. A verified name counts once."""
    each = matches.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.countDistinct(F.when(F.col("matched"), compact_query(F.col(name_col)))).alias("verified"),
    )
    status = F.when(F.col("total") == 0, "no_candidates").when(F.col("matched") == F.col("total"), "success").when(F.col("matched") > 0, "partial_success").otherwise("all_failed")
    return each.withColumns({"unverified": F.col("total") - F.col("matched"), "match_rate": F.coalesce(F.col("verified") / F.nullif(F.col("total"), F.lit(0)) * 100, F.lit(0.0)), "status": status})
