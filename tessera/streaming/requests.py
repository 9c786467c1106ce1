"""The one unbounded input, requests, through the same batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import read_requests


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Each batch of request files through analyse into a folder of its own, which a replayed batch writes over: exactly once."""

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").json(f"{outbox}/batch={number}")

    writer = read_requests(spark, inbox, streaming=True).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
