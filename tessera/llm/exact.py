"""Exact dedup with DataFrame functions only: rows are grouped by a 128-bit hash of their text, texts are compared within groups.

The texts are part of the grouping key next to their hash, so the aggregation itself compares bytes, and copies met by one task
are one row before anything is shuffled. A hash that belongs to one text only then stands for it, and rows find their group by
16 bytes. Rows whose hash belongs to several texts are joined by hash and text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Groups that hold at least one in so many rows are hot: there are no more of them than this, and each takes about 130 bytes.
HOT_GROUPS = 2000


def md5_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None, content_hash: Callable[[Column], Column] = md5_hash, hot_groups: int = HOT_GROUPS,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when their bytes are after `normalise` (by default nothing is changed); a null text counts as empty. The row
    with the smallest (or largest) id of equal texts is kept. A row without an id gives way to any equal one that has an id; if
    no row of a group has one, keep_id is null and all are kept. Repeated rows (equal id and text) are kept or dropped together.
    An empty table gives an empty result; columns other than the two named ones are not read.
    """
    least = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("text")).withColumn("hash", content_hash(F.col("text")))
    texts = rows.groupBy("hash", "text").agg(least("id").alias("keep_id"), F.count("*").alias("n"))
    texts = saved(texts.select("hash", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n"), "texts")
    hashes = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.max("n").alias("most"), F.sum("n").alias("rows"), F.any_value("sha").alias("sha"), F.any_value("keep_id").alias("keep_id"))
    groups = saved(hashes.where("most > 1"), "groups")
    single = groups.where("texts = 1").select("hash", "sha", "keep_id", F.col("rows").alias("n"))
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot, cold = single.where(F.col("n") * hot_groups >= total), single.where(F.col("n") * hot_groups < total)
    ids = saved(rows.select("id", "hash"), "ids")
    parts = [
        texts.where("n = 1").select(F.col("keep_id").alias("id"), "sha", "keep_id", "n"),
        ids.join(F.broadcast(hot), "hash").select("id", "sha", "keep_id", "n"),  # at most hot_groups rows
        ids.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(cold.hint("merge"), "hash").select("id", "sha", "keep_id", "n"),
    ]
    clashing = groups.where("texts > 1").select("hash")
    if clashing.limit(1).count():
        clash = rows.join(clashing.hint("merge"), "hash", "left_semi")
        own = clash.groupBy("hash", "text").agg(least("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
        parts.append(clash.join(own.hint("merge"), ["hash", "text"]).select("id", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all columns as they are; of rows that share an id and a text, one."""
    found = exact_duplicates(docs, id_col, text_col, keep, normalise).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_sha", F.sha2(normalise(text) if normalise else text, 256))
    kept = keyed.join(found.hint("merge"), keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    return kept.dropDuplicates([id_col, "_sha"]).select(*docs.columns)
