"""Merges: the images of one request, and two sources of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_list, known, ordered_distinct
from ..rules import UNKNOWN

#: Least confidences from which the second source goes first. Fixed values.
THRESHOLDS = {"product_name": 0.60, "capacity": 0.55, "usage": 0.55, "cautions": 0.55, "qr_url": 0.50}


def ordered(value: str | Column, order: str) -> Column:
    """The group's values in order, whatever the order in which a shuffle brought them."""
    v = F.col(value) if isinstance(value, str) else value
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda x: x["v"])


def merge_images(records: DataFrame, by: str, order: str, firsts: tuple[str, ...] = (), lists: tuple[str, ...] = (), texts: tuple[str, ...] = (), confidence: str | None = None) -> DataFrame:
    """One row per request: the first known value, lists joined and distinct, texts joined by blank lines, mean of the positive confidences."""
    told = [F.count("*").alias("n_images")]
    told += [F.min_by(known(F.col(c)), F.when(known(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in firsts]
    told += [clean_list(F.flatten(ordered(c, order))).alias(c) for c in lists]
    told += [F.array_join(clean_list(ordered(c, order)), "\n\n").alias(c) for c in texts]
    if confidence:
        told.append(F.coalesce(F.avg(F.when(F.col(confidence) > 0, F.col(confidence))), F.lit(0.0)).alias(confidence))
    return records.groupBy(by).agg(*told)


def override(base: DataFrame, extra: DataFrame, by: str, fields: tuple[str, ...], unions: tuple[str, ...] = (), success: str = "success") -> DataFrame:
    """base with the fields of extra where extra succeeded, empty ones too, and the unions of lists either way."""
    e = extra.select(by, F.col(success).alias("_ok"), *(F.col(c).alias(f"_x_{c}") for c in (*fields, *unions)))
    joined = base.join(e, by, "left")
    ok = F.coalesce("_ok", F.lit(False))
    new = {c: F.when(ok, F.col(f"_x_{c}")).otherwise(F.col(c)) for c in fields}
    new |= {c: clean_list(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.when(ok, F.coalesce(f"_x_{c}", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))) for c in unions}
    return joined.withColumns(new).select(*base.columns)


def choose_text(first: Column, second: Column, sure: Column, least: float) -> Column:
    """struct<value, reason>: the second source if it is sure, or the only one, or both are there; else the first."""
    a, b = known(first), known(second)
    reason = F.when(b.isNotNull() & (sure >= least), "second sure").when(b.isNotNull() & a.isNull(), "second only").when(a.isNotNull() & b.isNull(), "first only").when(b.isNotNull(), "both").otherwise("none")
    return F.struct(F.coalesce(b, a, F.lit(UNKNOWN)).alias("value"), reason.alias("reason"))


def choose_list(first: Column, second: Column, sure: Column, least: float) -> Column:
    """struct<value, reason>: the second list if it is sure or alone, the first if alone, else the second's items, then the first's."""
    a, b = clean_list(first), clean_list(second)
    has_a, has_b = F.size(a) > 0, F.size(b) > 0
    value = F.when(has_b & ((sure >= least) | ~has_a), b).when(has_a & ~has_b, a).when(has_a & has_b, clean_list(F.concat(b, a))).otherwise(F.array(F.lit(UNKNOWN)))
    reason = F.when(has_b & (sure >= least), "second sure").when(has_b & ~has_a, "second only").when(has_a & ~has_b, "first only").when(has_b, "both").otherwise("none")
    return F.struct(value.alias("value"), reason.alias("reason"))


def merge_sources(first: DataFrame, second: DataFrame, by: str, texts: tuple[str, ...], lists: tuple[str, ...], thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One row per key of either source with the chosen fields, and merge_log: what was chosen for each, and why.

    second has confidence_<field> columns; a missing one counts as 0.
    """
    a = first.select(by, *(F.col(c).alias(f"_a_{c}") for c in (*texts, *lists)))
    b = second.select(by, *(F.col(c).alias(f"_b_{c}") for c in (*texts, *lists)), *(F.col(f"confidence_{c}").alias(f"_c_{c}") for c in (*texts, *lists) if f"confidence_{c}" in second.columns))
    both = a.join(b, by, "full")
    chosen = {}
    for c in (*texts, *lists):
        sure = F.coalesce(F.col(f"_c_{c}"), F.lit(0.0)) if f"_c_{c}" in both.columns else F.lit(0.0)
        chosen[f"_m_{c}"] = (choose_text if c in texts else choose_list)(F.col(f"_a_{c}"), F.col(f"_b_{c}"), sure, thresholds.get(c, 0.55))
    both = both.withColumns(chosen)
    log = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_m_{c}.reason").alias("reason")) for c in (*texts, *lists)))
    return both.select(by, *(F.col(f"_m_{c}.value").alias(c) for c in (*texts, *lists)), log.alias("merge_log"))


def union_distinct(*lists: Column, key=None) -> Column:
    """Items of all lists, in order, once each."""
    every = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))
    return ordered_distinct(every, key) if key else clean_list(every)


def split_links(values: Column) -> Column:
    """struct<urls, others, primary>: which values are links, and the first of them."""
    link = r"(?i)^(?:https?://|www\.)\S+$|^[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+(?:/\S*)?$"
    urls, rest = F.filter(values, lambda x: x.rlike(link)), F.filter(values, lambda x: ~x.rlike(link))
    return F.struct(urls.alias("urls"), rest.alias("others"), F.coalesce(F.get(urls, F.lit(0)), F.get(rest, F.lit(0))).alias("primary"))
