"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics of every whole text are computed once, next to the text, and only those few numbers move on. Means and
covariances of both classes come from sums over all labelled training rows. Each class covariance is shrunk towards the
pooled one and towards a multiple of the identity, its Cholesky factor is inverted once, and a score is the logistic of
the difference of log densities, found from Mahalanobis lengths under the cached factors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, ROUND = 0.3, 0.05
#: Rows whose id has this remainder of its CRC are held out.
FOLDS, HELD_OUT = 3, 1

STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "short_words", "long_words", "repeated_pairs", "repeated_lines",
    "log_line_words", "letters", "capitals", "digits", "stops", "marks", "word_ends",
)

LETTER, CAPITAL, DIGIT, SPACE, STOP, MARK = range(6)


def _class_of(c: int) -> int:
    x = chr(c)
    return SPACE if x.isspace() else DIGIT if x.isdigit() else CAPITAL if x.isupper() else LETTER if x.isalpha() else STOP if x in ".,;:!?'\"()-" else MARK


#: Character classes up to U+024F; the characters beyond count as letters.
CLASSES = np.array([_class_of(c) for c in range(0x250)] + [LETTER], np.int64)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, square roots of shares; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(CLASSES[np.minimum(points, 0x250)], minlength=6)
    solid = max(1, len(points) - int(kinds[SPACE]))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(pairwise(words)))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    shares = [
        len(counts) / n, max(counts.values()) / n, np.count_nonzero(lengths <= 3) / n, np.count_nonzero(lengths >= 12) / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    characters = [kinds[LETTER] / solid, kinds[CAPITAL] / solid, kinds[DIGIT] / solid, kinds[STOP] / solid, kinds[MARK] / solid]
    ends = sum(not w[-1].isalnum() for w in words) / n
    return [float(np.log1p(n)), float(np.sqrt(lengths.mean())), *map(float, np.sqrt(shares)), float(np.log1p(n / max(1, len(lines)))), *map(float, np.sqrt(characters)), float(np.sqrt(ends))]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, stats) of every row."""
    prepared = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prepared = prepared.select("id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], stats], names=["id", "text_key", "stats"])

    return prepared.mapInArrow(run, f"id {prepared.schema['id'].dataType.simpleString()}, text_key bigint, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """log prior, mean, inverse Cholesky factor and log determinant of each class; `only` if but one class has rows, or none."""

    classes: tuple = ()
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        low, high = (prior - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - 0.5 * determinant for prior, mean, factor, determinant in self.classes)
        # Log density differences grow with the number of statistics; dividing by it keeps the sign.
        return 1 / (1 + np.exp(-np.clip((high - low) / x.shape[1], -700, 700)))


def fit(rows: DataFrame, pooled: float = POOLED, round_: float = ROUND) -> Discriminant:
    """rows: (stats, label 0 or 1), all of them; sums are taken within partitions and added up by Spark."""
    width = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(len(batch), width)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                own = x[y == label]
                total[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        label, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(label.ravel()), pa.array(place.ravel()), pa.array(total.ravel())], names=["label", "place", "value"])

    sums = np.zeros((2, 1 + width + width * width))
    for r in rows.select("stats", "label").mapInArrow(moments, "label bigint, place bigint, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["place"]] = r["value"]
    counts = sums[:, 0]
    if not counts.all():
        return Discriminant(only=0.5 if not counts.any() else float(counts[1] > 0))
    means = sums[:, 1 : 1 + width] / counts[:, None]
    scatter = [sums[c, 1 + width :].reshape(width, width) - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    common = (scatter[0] + scatter[1]) / max(1, counts.sum() - 2)
    classes = []
    for c in (0, 1):
        own = (1 - pooled) * scatter[c] / max(1, counts[c] - 1) + pooled * common
        own = (1 - round_) * own + round_ * max(np.trace(own) / width, 1e-6) * np.eye(width)
        factor = np.linalg.cholesky(own)
        classes.append((np.log(counts[c] / counts.sum()), means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(classes))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    The model is fitted on labelled rows that are not held out, by all of them. Labels other than 0 and 1, and ids whose
    labels disagree, teach nothing. A null text counts as empty, and is scored as an empty text is; a null id is never held
    out and never labelled. With labels of one class only every score is that class, with none it is 0.5. Repeated rows
    get equal scores; an empty table gives an empty result. Language, source and other columns are not read.
    """
    stats = saved(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).try_cast("double").alias("label")).where("id is not null and label in (0.0, 1.0)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("id", F.col("label").cast("int").alias("label"))
    model = fit(stats.where(~held_out("id")).join(known, "id").select("stats", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(len(batch), len(STATISTICS))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "text_key", "score", "predicted"])

    scored = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, text_key bigint, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), *["text_key"] * with_key, held_out("id").alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted good, with all columns as they are."""
    bad = score_quality(docs, labels, id_col, text_col, with_key=True).where("predicted = 0").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(bad.hint("merge"), docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_key")), "left_anti")
