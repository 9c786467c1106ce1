"""Stages with metrics that come along with their one pass: counts, errors and times, without a second one."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

SCHEMA = "position int, stage string, n_rows bigint, n_errors bigint, seconds double, failure string"


class Stages:
    """A flow of stages, each stored when it is made. What a stage raises is told in its metrics, and again to the caller."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.told: list[tuple] = []

    def run(self, name: str, df: DataFrame, error: Column | str | None = None) -> DataFrame:
        """df as a stored table; rows whose `error` is not null count as errors, they stay."""
        seen, began = Observation(f"{name}-{len(self.told)}"), time.time()
        wrong = F.count_if((F.col(error) if isinstance(error, str) else error).isNotNull()) if error is not None else F.lit(0).cast("bigint")
        try:
            out = saved(df.observe(seen, F.count("*").alias("n_rows"), (F.sum(F.lit(0)) if error is None else wrong).cast("bigint").alias("n_errors")), name)
        except Exception as e:
            self.told.append((len(self.told), name, None, None, time.time() - began, f"{type(e).__name__}: {str(e)[:500]}"))
            raise
        counts = seen.get
        self.told.append((len(self.told), name, counts["n_rows"], counts["n_errors"] or 0, time.time() - began, None))
        return out

    def metrics(self) -> DataFrame:
        """(position, stage, n_rows, n_errors, seconds, failure), a row for each stage so far."""
        return self.spark.createDataFrame(self.told, SCHEMA)

    def report(self) -> str:
        """The metrics as lines of text."""
        lines = [f"{p + 1}. {stage}: " + (f"failed, {failure}" if failure else f"{n:,} rows, {wrong:,} with errors") + f", {s:.1f} s" for p, stage, n, wrong, s, failure in self.told]
        return "\n".join([*lines, f"{len(self.told)} stages, {sum(t[4] for t in self.told):.1f} s"])
