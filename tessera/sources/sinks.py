"""Sinks: stage snapshots, reports and payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import safe_list, value_or_unknown


def save_stage(df: DataFrame, folder: str, stage: str, run_id: str, kind: str = "json") -> None:
    """One folder per stage and run; a rerun replaces its own run only."""
    df.write.mode("overwrite").format(kind).save(f"{folder}/stage={stage}/run_id={run_id}")


def attempted(spark: SparkSession, saves: dict[str, Callable[[], None]]) -> DataFrame:
    """Each save in turn, as (position, name, saved, error): one that fails is told and stops no other."""
    told = []
    for i, (name, save) in enumerate(saves.items()):
        try:
            save()
            told.append((i, name, True, None))
        except Exception as e:  # a snapshot that fails does not cost the results
            told.append((i, name, False, f"{type(e).__name__}: {str(e)[:500]}"))
    return spark.createDataFrame(told, "position int, name string, saved boolean, error string")


def save_text(df: DataFrame, folder: str, column: str = "text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def numbered(title: str, items: Column) -> Column:
    """A titled list, each item on a line with its number."""
    lines = F.transform(safe_list(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.lit(f"[{title}]\n"), F.array_join(lines, "\n"))


def report(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df with a readable report of the named list and text columns."""
    parts = [numbered(t, F.col(c)) if dict(df.dtypes)[c].startswith("array") else F.concat(F.lit(f"[{t}]\n"), value_or_unknown(F.col(c))) for c, t in fields.items()]
    return df.withColumn("report", F.concat_ws("\n\n", *parts))


def payload(df: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, payload): every other column as one JSON document; nulls are left out."""
    return df.select(by, F.to_json(F.struct(*(c for c in df.columns if c != by))).alias("payload"))


def push(df: DataFrame, send: Callable[[str], int]) -> DataFrame:
    """A delivery log (payload, status, error) of an injected sender; nothing is sent until the log is read or written."""
    from .readers import call_out

    return call_out(df.select("payload"), lambda r: {"payload": r["payload"], "status": send(r["payload"])}, "payload string, status int, error string")
