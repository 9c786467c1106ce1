"""Requests whose images come one by one, as a stream with state: a request closes when all came or its time ran out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "request_id string, first_at timestamp, last_at timestamp, n_images int, received int, outcome string"
#: When the session began and its newest image came, in microseconds, how many images it awaits, which came, and whether it was told.
STATE = "first bigint, last bigint, awaits int, seen array<int>, told boolean"


def sessions(images: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(request_id, first_at, last_at, n_images, received, outcome) of images (request_id, image_index, n_images, at), a stream.

    A session begins with an image and takes those of the same request that come up to `wait` later. With the n_images-th
    distinct image it is complete; when the watermark, `late` behind the newest image, passes its end before, it is timed out. Images
    that came before, or after the session was complete, change nothing. Later ones begin another session. State holds open
    sessions only, and what is late by the watermark is dropped.
    """
    length = int(pd.Timedelta(wait).total_seconds() * 1_000_000)

    def told(key: str, s: list, outcome: str) -> tuple:
        return key, pd.Timestamp(s[0], unit="us"), pd.Timestamp(s[1], unit="us"), s[2], len(s[3]), outcome

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, open_ = [], list(state.get) if state.exists else None
        if open_:
            open_[3] = list(open_[3])
        if state.hasTimedOut:
            if not open_[4]:
                out.append(told(keys[0], open_, "timed out"))
            state.remove()
        else:
            rows = sorted((int(us), int(index), int(n)) for batch in batches for us, index, n in zip(batch["us"], batch["image_index"], batch["n_images"]))
            for us, index, n in rows:
                if open_ is None or us > open_[0] + length:
                    if open_ is not None and not open_[4]:
                        out.append(told(keys[0], open_, "timed out"))
                    open_ = [us, us, n, [], False]
                if not open_[4] and index not in open_[3]:
                    open_[3].append(index)
                    open_[1] = us
                    if len(open_[3]) >= open_[2]:
                        out.append(told(keys[0], open_, "complete"))
                        open_[4] = True
            state.update(tuple(open_))
            state.setTimeoutTimestamp(max((open_[0] + length) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    rows = images.withWatermark("at", late).select(F.col("request_id").cast("string").alias("request_id"), F.col("image_index").cast("int").alias("image_index"), F.col("n_images").cast("int").alias("n_images"), "at", F.unix_micros("at").alias("us"))
    rows = rows.where("request_id is not null and image_index is not null and n_images is not null and us is not null")
    return rows.groupBy("request_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_sessions(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, schema: str, wait: str, late: str, files_a_batch: int = 1000) -> DataFrame:
    """What has come into `inbox` (Parquet) since the last run, through sessions into `outbox`; what lies in outbox after that.

    A run that was stopped is taken up from its checkpoint; each batch reaches the outbox once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(inbox)
    query = sessions(stream, wait, late).writeStream.format("parquet").option("path", outbox).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(outbox)
