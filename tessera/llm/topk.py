"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are dealt to PARTS parts, whose local scores add up to the score; a local score is at most the
product of the two parts' lengths. Phase 1 gathers local score lists: each partition scores its longest rows only, and
the k-th best score among those of all partitions is a cutoff that is surely met. Phase 2 broadcasts the cutoff: to reach it a
row needs a local score of cutoff / PARTS in some part, so a row whose bounds stay below that everywhere, or whose
bounds add up to less than the cutoff, is not scored at all. The others get the local score of the first part, and go on if it
and the bounds of the other parts can still reach the cutoff. Phase 3 resolves the remaining scores exactly.
Queries are taken in blocks of at most QUERY_BLOCK, which bounds what is broadcast; every block meets all rows and is stored on
its own. A partition sends at most k rows a query, so a vector that many rows share is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, work_path

PARTS = 4
#: Queries in a broadcast block, those compared at once, and rows scored at once in a task.
QUERY_BLOCK, QUERY_STEP, ROW_BLOCK = 1 << 14, 512, 1024
#: Sums of products below this are exact in floating point; beyond it Python's integers take over.
EXACT = 1 << 53
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Bounds are a little more than what rounding could take from them.
SLACK = 1 + 1e-9

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): components as doubles; rows without an id, or with null or non-finite components, go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(good)


def matrix(lists: list, width: int) -> np.ndarray:
    """Rows padded with zeros to the width, or cut."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        n = min(len(x), width)
        out[i, :n] = x[:n]
    return out


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), ROW_BLOCK):
            part = batch.slice(start, ROW_BLOCK)
            column = part.column(1)
            even = (np.diff(column.offsets.to_numpy()) == width).all()
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width) if even else matrix(column.to_numpy(zero_copy_only=False), width)
            yield part.column(0).to_numpy(zero_copy_only=False), values


def whole(x: float, scale: int) -> int:
    """floor(scale * x), the product as a double; where that overflows, x is an integer and so is the exact product."""
    product = x * scale
    return floor(product) if abs(product) < float("inf") else int(x) * scale


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def lengths(q: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the parts of each row."""
    return np.stack([np.sqrt((q[:, a:b] ** 2).sum(axis=1)) for a, b in zip(edges, edges[1:])], axis=1)


def best_pairs(pairs: Pairs, k: int) -> Pairs:
    """The k best of each query, ties to the smaller id. Scores may be Python's integers."""
    query, ids, scores = pairs
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (query[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    order = order[rank < k]
    return pairs[0][order], ids[order], scores[order]


def reaching(q: np.ndarray, q_length: np.ndarray, s: np.ndarray, s_length: np.ndarray, cutoff: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs whose score reaches the query's cutoff; the first part ends at edge."""
    parts = q_length.shape[1]
    able = np.flatnonzero((q_length.max(axis=0) @ s_length.T) * SLACK + 1 >= cutoff.min())
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(able):
        return none
    s, s_length = s[able], s_length[able]
    alive = (q_length @ s_length.T) * SLACK + 1 >= cutoff[:, None]
    uniform = np.zeros_like(alive)
    for p in range(parts):
        uniform |= np.outer(q_length[:, p], s_length[:, p]) * SLACK + 1 >= cutoff[:, None] / parts
    alive &= uniform
    rows = np.flatnonzero(alive.any(axis=0))
    if not len(rows):
        return none
    s, s_length, alive, able = s[rows], s_length[rows], alive[:, rows], able[rows]
    local = q[:, :edge] @ s[:, :edge].T
    alive &= local + (q_length[:, 1:] @ s_length[:, 1:].T) * SLACK + 1 >= cutoff[:, None]
    i, j = np.nonzero(alive)
    if len(i) * 8 > alive.size:  # so many that all at once are quicker
        score = (local + q[:, edge:] @ s[:, edge:].T)[i, j]
    else:
        score = local[i, j] + np.einsum("ij,ij->i", q[i, edge:], s[j, edge:])
    take = score >= cutoff[i]
    return i[take], able[j[take]], score[take]


def _phase(rows: DataFrame, ids: np.ndarray, values: np.ndarray, k: int, scale: int, parts: int, cutoffs: np.ndarray | None) -> DataFrame:
    """(query, id, score, beyond): phase 1 without cutoffs, over the first rows of each partition; else phases 2 and 3.

    beyond is null, or for scores outside of 64 bits a text that sorts as they do.
    """
    sent = rows.sparkSession.sparkContext.broadcast((ids, values, cutoffs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_values, cutoffs = sent.value
        width, n = q_values.shape[1], len(q_ids)
        edges = np.linspace(0, width, parts + 1).astype(int)
        q = quantised(q_values, scale)
        q_most = np.abs(q).max(axis=1, initial=1)
        # Queries so large that products with ones would not be exact are compared in Python's integers.
        plain = np.flatnonzero(q_most * max(1, width) < EXACT)
        large = np.flatnonzero(q_most * max(1, width) >= EXACT)
        q_length = lengths(np.where(np.isfinite(q), q, 0), edges)
        least = np.full(n, -np.inf) if cutoffs is None else cutoffs.copy()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        slow = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        for row_ids, row_values in _rows(batches, width):
            s = quantised(row_values, scale)
            s_most = np.abs(s).max(axis=1, initial=1)
            fits = s_most * q_most[plain].max(initial=1) * max(1, width) < EXACT
            small = np.flatnonzero(fits)
            s_length = lengths(s[small], edges)
            found = [tuple(held)]
            for a in range(0, len(plain) if len(small) else 0, QUERY_STEP):
                own = plain[a : a + QUERY_STEP]
                i, j, score = reaching(q[own], q_length[own], s[small], s_length, least[own], edges[1] if parts > 1 else width)
                other = q_ids[own[i]] != row_ids[small[j]]
                found.append((own[i[other]], row_ids[small[j[other]]], score[other]))
            held = best_pairs(tuple(map(np.concatenate, zip(*found))), k)
            # What k rows of this task reach is a cutoff too.
            full = np.flatnonzero(np.bincount(held[0], minlength=n) >= k)
            if len(full):
                worst = np.full(n, np.inf)
                np.minimum.at(worst, held[0], held[2])
                least[full] = np.maximum(least[full], worst[full])
            if cutoffs is None:
                break
            odd = np.flatnonzero(~fits)
            if len(large) or len(odd):
                exact = lambda x: np.array([[whole(v, scale) for v in r] for r in x.tolist()], object).reshape(len(x), width)
                for which, against in ((np.arange(n), odd), (large, small)):
                    if len(which) and len(against) and width:
                        scores = exact(q_values[which]) @ exact(row_values[against]).T
                        i, j = np.nonzero(q_ids[which][:, None] != row_ids[against][None, :])
                        slow = best_pairs((np.concatenate([slow[0], which[i]]), np.concatenate([slow[1], row_ids[against[j]]]), np.concatenate([slow[2], scores[i, j]])), k)
        for query, own, score in (held, slow):
            exact = [int(x) for x in score.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[query]), pa.array(own, pa.int64()), pa.array([min(max(x, LOWEST), HIGHEST) for x in exact], pa.int64()), pa.array([None if LOWEST < x <= HIGHEST else sortable(x) for x in exact], pa.string())],
                names=["query", "id", "score", "beyond"],
            )

    return rows.mapInArrow(run, "query bigint, id bigint, score bigint, beyond string")


def sortable(x: int) -> str:
    """A text that sorts as the integer does, for integers of fewer than a thousand digits."""
    digits = str(abs(x))
    if x >= 0:
        return f"1{len(digits):03d}{digits}"
    return f"0{999 - len(digits):03d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, parts: int = PARTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with rows of another id.

    Components x become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part. Shorter vectors count as padded with zeros. Ties go to the smaller id; of queries that share an id the
    one with the least vector, component by component, counts; repeated rows count each. Scores are exact however large the
    components; one outside of 64 bits is told as the nearest 64-bit integer and ranked by its exact value. A query without
    candidates has no rows; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    size = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    rows = saved(usable(vectors, id_col, vector_col).sortWithinPartitions(size.desc()), "vectors")
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    width = asked.agg(F.max(F.size("v"))).first()[0] or 0
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "id")
    path = work_path(spark, "best")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        own = asked.where(F.col("block") == b).select("id", "v").toPandas()  # about query_block rows
        if not len(own):
            continue
        ids, values = own.id.to_numpy(np.int64), matrix(own.v.tolist(), width)
        first = _phase(rows, ids, values, k, scale, parts, None).withColumn("rank", F.row_number().over(order)).where(f"rank = {k}").select("query", "score").toPandas()
        known = dict(zip(first["query"].tolist(), first.score.tolist()))
        # Without a k-th row there is no cutoff: whatever is there is taken.
        cutoffs = np.array([known.get(i, -np.inf) for i in ids.tolist()], np.float64)
        best = _phase(rows, ids, values, k, scale, parts, cutoffs).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
        best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
