"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved, work_path  # noqa: F401  (for the operators)

#: Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def list_array(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values, as uint64, of an Arrow list<int64> column."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return (offsets - offsets[0]).astype(np.int64), values.view(np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets, from 0, of a column of strings; a null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` values each, so that working arrays stay small; a longer row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, rows)
        start = min(end, rows)


def odd_constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values, by doubling: result[i] covers values[i : i + n]."""
    if len(values) < n:
        return values[:0]
    constants = odd_constants(seed, 2 * n.bit_length())
    out, length, power, size, step = None, 0, values, 1, 0
    while True:
        if n & size:
            if out is None:
                out, length = power, size
            else:
                out = mix(out[: len(values) - length - size + 1] * constants[2 * step] + power[length : len(values) - size + 1])
                length += size
        size, step = 2 * size, step + 1
        if size > n:
            return out if length > 1 else mix(out)
        power = mix(power[: len(power) - size // 2] * constants[2 * step - 1] + power[size // 2 :])


def sliding(values: np.ndarray, n: int, what: np.ufunc) -> np.ndarray:
    """what.reduce of every run of n consecutive values; n at most len(values)."""
    size = 1
    while 2 * size <= n:
        values, size = what(values[:-size], values[size:]), 2 * size
    return what(values[: len(values) - (n - size)], values[n - size :]) if n > size else values
