"""Order statistics of groups of any size: no group is collected, none lies in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import cut_groups, placed, same


def _came_before(rows: DataFrame, by: tuple[str, ...], what: Column, name: str, until: Callable[[Column], Column]) -> DataFrame:
    """(by, _block, name) of the blocks that a group continues in: until(what) over its earlier blocks. Fewer rows than blocks."""
    cut = cut_groups(rows, by)
    totals = rows.join(F.broadcast(cut), same(rows, cut, by), "left_semi").groupBy(*by, "_block").agg(what.alias(name))
    return totals.select(*by, "_block", until(F.col(name)).over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias(name)).where(F.col(name).isNotNull())


def kth_values(rows: DataFrame, by: tuple[str, ...], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, name...): of each group's n values that are not null, those whose place from 0 in ascending order is ranks[name](n).

    Equal values are counted before anything is sorted; running counts, over the sort's blocks and then over the blocks of a group,
    tell which value stands at a place.
    """
    counts = placed(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_times")), by, (value,), "counts")
    own = Window.partitionBy(*by, "_block").orderBy("_at")
    told = counts.withColumns({"_upto": F.sum("_times").over(own), "_n": F.sum("_times").over(Window.partitionBy(*by, "_block"))})
    before = _came_before(counts, by, F.sum("_times"), "_before", F.sum)
    cut = cut_groups(counts, by)
    whole = counts.join(F.broadcast(cut), same(counts, cut, by), "left_semi").groupBy(*by).agg(F.sum("_times").alias("_whole"))
    told = told.join(F.broadcast(before), same(told, before, by) & (told["_block"] == before["_block"]), "left").select(*(told[c] for c in told.columns), "_before")
    told = told.join(F.broadcast(whole), same(told, whole, by), "left").select(*(told[c] for c in told.columns), "_whole")
    n, upto = F.coalesce("_whole", "_n"), F.col("_upto") + F.coalesce("_before", F.lit(0))
    hits = {name: F.max(F.when((rank(n) >= upto - F.col("_times")) & (rank(n) < upto), F.col(value))).alias(name) for name, rank in ranks.items()}
    return told.groupBy(*by).agg(F.max(n).alias("n"), *hits.values())


def medians(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by, median): the middle value, or the mean of the two in the middle."""
    two = kth_values(rows, by, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return two.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def with_step(rows: DataFrame, by: tuple[str, ...], value: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows in order of the value, with _step: how much more it is than the one before, null for a group's first."""
    sorted_ = placed(rows, by, (value, *ties))
    before = _came_before(sorted_, by, F.max(value), "_last", F.max)
    inside = F.lag(value).over(Window.partitionBy(*by, "_block").orderBy("_at"))
    told = sorted_.withColumn("_lag", inside)
    told = told.join(F.broadcast(before), same(told, before, by) & (told["_block"] == before["_block"]), "left").select(*(told[c] for c in told.columns), "_last")
    return told.withColumn("_step", F.col(value) - F.coalesce("_lag", "_last")).select(*rows.columns, "_step")
