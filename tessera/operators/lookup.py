"""Joins of rows with a table of their distinct values, safe where one value holds a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: Values that hold at least one in so many rows are hot: there are no more of them than this.
HOT_VALUES = 2000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, hot_values: int = HOT_VALUES) -> DataFrame:
    """rows with the columns of `table`, which has each key of rows once and in `count` how many rows have it.

    Hot keys are broadcast, with whatever the table tells of them: at most hot_values rows, so its columns should be small. The
    others are joined by a shuffle. rows and table: stored tables, since they are read twice.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot, cold = table.where(F.col(count) * hot_values >= total).drop(count), table.where(F.col(count) * hot_values < total).drop(count)
    known = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return known.unionByName(rest.join(cold.hint("merge"), key).select(known.columns))


def of_distinct(rows: DataFrame, text: str, told: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """rows, a stored table, with what `told` adds to the distinct texts: each text is worked out once, and found by its MD5.

    told: a table (text) -> one with more columns, which should be small, as they are kept for each distinct text.
    """
    distinct = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("_times"))
    facts = told(distinct).withColumn("_id", F.unhex(F.md5("text"))).drop("text")
    table = saved(facts, label)
    return joined_by_key(rows.withColumn("_id", F.unhex(F.md5(text))), table, "_id", "_times").drop("_id")
