"""The whole flow as a job: spark-submit tessera/job.py --requests FOLDER --fields TABLE --out FOLDER [--catalogue TABLE] [--answers TABLE]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def healthy(spark: SparkSession) -> bool:
    """Whether executors answer."""
    return spark.range(1).count() == 1


def run(spark: SparkSession, requests: str, fields: str, out: str, run_id: str, catalogue: str | None = None, answers: str | None = None) -> str:
    """Reads requests as JSON lines and the others as Parquet; writes records, payloads, failures and metrics, and tells what was done."""
    from tessera.operators import flow, records
    from tessera.sources import readers, sinks

    table = lambda path: spark.read.parquet(path) if path else None
    asked = readers.read_requests(spark, requests)
    done = flow.analyse(asked, spark.read.parquet(fields), table(catalogue), table(answers))
    first_url = asked.groupBy("user_id").agg(F.min_by(F.get("image_urls", F.lit(0)), F.size("image_urls")).alias("image_url"))
    stage = lambda df, name: lambda: sinks.save_stage(df, out, name, run_id)
    saves = {
        "records": stage(done.records, "records"), "stored": stage(records.nested_payload(done.records, "user_id"), "stored"),
        "payloads": stage(records.flat_payload(done.records).join(first_url, "user_id", "left"), "payloads"), "failures": stage(done.failures, "failures"),
        "metrics": stage(done.stages.metrics(), "metrics"),
    }
    told = sinks.attempted(spark, saves).orderBy("position").collect()
    return "\n".join([done.stages.report(), *(f"{r.name}: " + ("saved" if r.saved else f"not saved, {r.error}") for r in told)])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, need in (("requests", True), ("fields", True), ("out", True), ("run_id", False), ("catalogue", False), ("answers", False)):
        parser.add_argument(f"--{name}", required=need)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if not healthy(spark):
        sys.exit("no executor answers")
    print(run(spark, a.requests, a.fields, a.out, a.run_id or spark.sparkContext.applicationId, a.catalogue, a.answers))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main()
