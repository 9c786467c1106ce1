"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with the same shingle set form one class, and only classes are compared. In each bucket the class with the
smallest id is the centre, and only pairs with it are candidates, so a bucket of n classes gives n - 1 pairs. Candidates
are confirmed on full sets. A star can miss a link between two members that are both unlike the centre, so the members of
buckets that still hold several components go through an exact prefix join over their shingles; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, gram_hashes, hashed, list_array, mix, odd_constants, saved, slices, words_of
from .graph import connected_components

SHINGLE = 5
#: A pair with a similarity of 0.75 shares a bucket with a probability of 1 - (1 - 0.75 ** ROWS) ** BANDS, or 0.99998, one of 0.27 with 0.008.
BANDS, ROWS = 75, 7
PERCENT = 75


def shingle_sets(values: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; one for the whole sequence if it is shorter."""
    grams = gram_hashes(values, size, 21)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        else:
            yield gram_hashes(values[a:b], b - a, 22 + b - a) if b > a else values[:0]


@lru_cache
def probe_order(bins: int) -> np.ndarray:
    """order[i, j]: when bin i, if empty, would try bin j; the same random order for every document."""
    return np.argsort(np.random.default_rng(23).random((bins, bins)), axis=1).argsort(axis=1).astype(np.int16)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set: the least hash of each bin; an empty bin takes that of the first full bin that it tries."""
    place = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    full = place[first]
    out = np.empty(bins, np.uint64)
    out[full] = shingles[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = out[full[np.argmin(probe_order(bins)[np.ix_(empty, full)], axis=1)]]
    return out


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    own = signature(shingles, bands * rows).reshape(bands, rows)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    constants = odd_constants(24, rows)
    for r in range(rows):
        out = mix(out * constants[r] + own[:, r])
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def _scan(keyed: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, text_key, n_shingles, two hashes of the shingle set, and its band hashes."""
    prepared = keyed.select("id", "text_key", hashed(words_of(ascii_lower(F.col("text")))).alias("hashes"))
    id_type = prepared.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = odd_constants(25, 1)[0]
        for batch in batches:
            every, values = list_array(batch.column(2))
            for a, b in slices(every):
                size, one, two, bucket = [], [], [], []
                for s in shingle_sets(values[every[a] : every[b]], every[a : b + 1] - every[a]):
                    size.append(len(s))
                    one.append(np.add.reduce(mix(s)))
                    two.append(np.add.reduce(mix(s * second)))
                    bucket.append(band_hashes(s, bands, rows).view(np.int64) if len(s) else s.view(np.int64))
                numbers = [pa.array(size, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two))]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:2], *numbers, pa.array(bucket, pa.list_(pa.int64()))], names=["id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return prepared.mapInArrow(run, f"id {id_type}, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text)."""
    prepared = texts.select("id", hashed(words_of(ascii_lower(F.col("text")))).alias("hashes"))
    id_type = prepared.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, values = list_array(batch.column(1))
            for a, b in slices(every):
                sets = [s.view(np.int64) for s in shingle_sets(values[every[a] : every[b]], every[a : b + 1] - every[a])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return prepared.mapInArrow(run, f"id {id_type}, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("na", F.size("sa")).withColumn("nb", F.size("sb"))
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", shared).where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def length_block(n: Column) -> Column:
    """Blocks of set sizes, rising with n; four of them to a doubling."""
    return F.floor(F.log2(n) * 4).cast("int")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of members (id, label) with different labels that can be similar enough; no such pair is left out.

    Shingles are put in one order for all sets: first those that a single label has, then rare ones before common ones.
    Similar sets of n and m shingles share so many that the first shared one must come early in both: with p and q
    shingles before it, min(n - p, m - q) is at least percent / (100 + percent) of n + m. So pairs come from a join
    on early shingles under that condition. Rows of a shingle's largest component meet only those of the others, and
    rows of one length only those of lengths that the condition leaves possible: a set of n shingles, `rest` of which
    are left, can be like sets of percent / 100 * n to rest * (100 + percent) / percent - n shingles.
    """
    weights = members.groupBy("label").agg(F.count("*").alias("weight"))
    each = saved(members.join(weights, "label").join(sets, "id").select("id", "label", "weight", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle", "f")
    met = each.join(saved(common, "common").hint("merge"), "shingle")
    ordered = met.groupBy("id").agg(F.any_value("label").alias("label"), F.any_value("weight").alias("weight"), F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    early = ordered.select("id", "label", "weight", "n", F.posexplode(F.expr(f"slice(s, 1, greatest(0, size(s) - cast(ceil(n * {percent} / 100) as int) + 1))")).alias("p", "s"), F.size("s").alias("_met"))
    early = saved(early.select(F.col("s.shingle").alias("shingle"), "id", "label", "weight", "n", F.expr("_met - p").alias("rest")), "early")
    mains = early.groupBy("shingle").agg(F.max(F.struct("weight", "label")).getField("label").alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle", "main")
    rows = saved(early.join(saved(mains, "mains").hint("merge"), "shingle"), "early")
    other = rows.where("label <> main").select("shingle", F.col("id").alias("c"), F.col("label").alias("c_label"), F.col("n").alias("c_n"), F.col("rest").alias("c_rest"))
    least, most = F.ceil(F.col("c_n") * percent / 100), F.floor(F.col("c_rest") * (100 + percent) / percent - F.col("c_n"))
    other = other.where(least <= most).withColumn("block", F.explode(F.sequence(length_block(least), length_block(most))))
    able = f"label <> c_label and (label = main or id > c) and least(rest, c_rest) * {100 + percent} >= (n + c_n) * {percent}"
    found = rows.withColumn("block", length_block(F.col("n"))).join(other, ["shingle", "block"]).where(able)
    return found.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are compared with A-Z in lower case. A document without words or text has no shingles and is linked with
    nothing; so is a row without an id, whose component_id is null and which is kept. Rows that share an id and a text
    stand or fall together. An empty table gives an empty result; other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    scanned = saved(_scan(keyed, bands, rows), "signatures")
    real = scanned.where("id is not null and n_shingles > 0")
    classes = saved(real.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands")), "classes")
    members = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = saved(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1"), "centres")
    shared = saved(members.join(buckets.hint("merge"), "bucket"), "buckets")
    needed = shared.select("id").distinct()
    sets = saved(_sets(keyed.join(needed.hint("merge"), "id").select("id", "text", "text_key").dropDuplicates(["id", "text_key"]).select("id", "text")), "sets")
    pairs = shared.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    labels = connected_components(saved(confirmed(pairs, sets, percent), "links"))
    # What stars may have missed: links between components that meet in a bucket.
    own = shared.join(labels, "id", "left").select("id", "bucket", F.coalesce("label", "id").alias("label"))
    several = saved(own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"), "several")
    open_ = saved(own.join(several.hint("merge"), "bucket").select("id", "label").distinct(), "open")
    found = saved(confirmed(prefix_pairs(open_, sets, percent), sets, percent), "links")
    if found.limit(1).count():
        a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        merged = connected_components(found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        every = labels.select("id", "label").union(merged.select("id", F.col("id").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
        labels = saved(every.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    component = saved(classes.select("set_a", "set_b", "id").join(labels, "id", "left").select("set_a", "set_b", F.coalesce("label", "id").alias("component")), "components")
    key = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_a"))
    result = scanned.select("id", "text_key", "n_shingles", key.alias("set_a"), "set_b").join(component.hint("merge"), ["set_a", "set_b"], "left")
    component_id = F.coalesce("component", "id")
    return result.select(F.col("id").alias(id_col), *["text_key"] * with_key, "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all columns as they are; of rows that share an id and a text, one."""
    found = near_duplicates(docs, id_col, text_col, with_key=True).where("kept").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"))
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = keyed.join(found.hint("merge"), keyed[id_col].eqNullSafe(F.col("_id")) & (keyed["_key"] == found["_key"]), "left_semi")
    # Repeated rows are told by id and text; texts without an id are no copies of one another.
    known, nameless = kept.where(F.col(id_col).isNotNull()), kept.where(F.col(id_col).isNull())
    return known.dropDuplicates([id_col, "_key"]).unionByName(nameless).select(*docs.columns)
