"""Substring dedup by compaction of a sparse de Bruijn graph over token k-mers.

A window of WINDOW words holds at least one anchor: a k-mer that has the least hash among the k-mers of some
window. Anchors are the edges of a de Bruijn graph over words; the path from an anchor to the next one is labelled by
the words between. Joins tell which anchors occur in several documents, which document is the first, and whether
all occurrences go on, or come from, the same way. Where they do, the path is nonbranching and compact: every
document with one of its anchors holds all of it, so a window inside it repeats in exactly the documents that have
the window's own anchor. Only windows across a branch or an end are compared one by one, by 128-bit hashes at their source
coordinates. Anchors are a twentieth of the words, so the joins stay far smaller than the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hashed, list_array, mix, odd_constants, saved, slices, sliding, words_of

WINDOW, K = 50, 12
END = np.uint64(0x5BD1E995_9D2C5680)
FAR = np.uint64(0xFFFFFFFF_FFFFFFFF)


def anchors(values: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in values, k-mer hashes, rows) of the anchors of many documents' word hashes.

    Every k-mer with the least hash of a window is an anchor, ties included, so equal windows have equal anchors.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(values) < window:
        return none
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][rows]
    grams = gram_hashes(values, k, 11)
    wide = window - k + 1  # k-mers in a window
    least = sliding(grams, wide, np.minimum)
    starts = np.arange(len(least))
    least = np.where(starts + window <= ends[: len(least)], least, np.uint64(0))  # 0: not a window of one document
    around = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
    most = sliding(around, wide, np.maximum)  # for each k-mer, over the windows that hold it
    at = np.flatnonzero((most[: len(grams)] == grams) & (most[: len(grams)] > 0))
    return at, grams[at], rows[at]


def path_labels(values: np.ndarray, at: np.ndarray, grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Labels of the paths to the next anchor of the same document: both ends and the words between; END after the last one."""
    if not len(at):
        return np.zeros(0, np.uint64)
    base = odd_constants(12, 1)[0]
    powers = np.cumprod(np.full(len(values) + 1, base, np.uint64))
    inverse = np.cumprod(np.full(len(values) + 1, pow(int(base), -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values) * powers[: len(values)])])
    a, b = at[:-1], at[1:]
    label = mix((sums[b] - sums[a]) * inverse[a] + mix((b - a).astype(np.uint64)))
    label = mix(mix(label + grams[:-1]) * base + grams[1:])
    return np.append(np.where(rows[:-1] == rows[1:], label, END), END)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the hash of the text: rows that share an id are told apart by their texts."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _scan(keyed: DataFrame) -> DataFrame:
    """One row per document: id, text_key, n_words, kept_sha256 if nothing goes, and its anchors as parallel lists."""
    prepared = keyed.select("id", "text_key", words_of(F.col("text")).alias("words")).select("id", "text_key", F.sha2(F.array_join("words", " "), 256).alias("sha"), hashed(F.col("words")).alias("hashes"))
    id_type = prepared.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, text_key bigint, sha string, n_words bigint, pos array<int>, kmer array<bigint>, next array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, values = list_array(batch.column(3))
            for a, b in slices(every):
                part, offsets = values[every[a] : every[b]], every[a : b + 1] - every[a]
                at, grams, rows = anchors(part, offsets)
                after = path_labels(part, at, grams, rows)
                bounds = pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((at - offsets[:-1][rows]).astype(np.int32), grams.view(np.int64), after.view(np.int64))]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(np.diff(offsets)), *lists], names=["id", "text_key", "sha", "n_words", "pos", "kmer", "next"])

    return prepared.mapInArrow(run, schema)


def suspects(values: np.ndarray, doc: int, pos: np.ndarray, first: np.ndarray, goes: np.ndarray, comes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one document and its repeated anchors (by position; first: the first document that has the anchor; goes, comes:
    whether all occurrences have the same path onward, or back): starts of windows that surely repeat, and of those to compare."""
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < WINDOW:
        return none, none
    at, grams, _ = anchors(values, np.array([0, n]))
    place = np.searchsorted(pos, at)
    place[place == len(pos)] = 0
    repeated = pos[place] == at
    link = repeated[:-1] & repeated[1:] & goes[place[:-1]] & comes[place[1:]]
    path = np.concatenate([[0], np.cumsum(~link)])
    start = np.arange(n - WINDOW + 1)
    last = start + WINDOW - K  # the last k-mer of the window
    a, b = np.searchsorted(at, start, "left"), np.searchsorted(at, last, "right") - 1
    # The window's own anchor, its least k-mer, is an anchor wherever the window stands; others may not be.
    own = a.copy()
    for step in range(1, int((b - a).max()) + 1):
        other = np.minimum(a + step, b)
        own = np.where(grams[other] < grams[own], other, own)
    outer_a, outer_b = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, last, "left")
    inside = (outer_a >= 0) & (outer_b < len(at)) & repeated[own]
    inside &= path[outer_a.clip(0)] == path[outer_b.clip(0, len(at) - 1)]
    sure = inside & (first[place[own]] < doc)
    return start[sure], start[repeated[own] & ~inside]


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and lengths of the runs of consecutive numbers."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) != 1)
    return starts[new], np.diff(np.append(new, len(starts)))


def _windows(flagged: DataFrame) -> DataFrame:
    """Per flagged document: id, text_key, text, runs of sure windows (start, number), and the windows to compare (start, two hashes)."""
    prepared = flagged.select("id", "text_key", "text", "flags", hashed(words_of(F.col("text"))).alias("hashes"))
    id_type = prepared.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, text_key bigint, text string, run_start array<bigint>, run_length array<bigint>, start array<bigint>, hash_a array<bigint>, hash_b array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, values = list_array(batch.column(4))
            flag_offsets = batch.column(3).offsets.to_numpy()
            flags = batch.column(3).values
            pos, first, goes, comes = (flags.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids = batch.column(0).to_pylist()
            for a, b in slices(every):
                out: list[list] = [[], [], [], [], []]
                for i in range(a, b):
                    own = values[every[i] : every[i + 1]]
                    x, y = flag_offsets[i], flag_offsets[i + 1]
                    order = np.argsort(pos[x:y], kind="stable")
                    sure, open_ = suspects(own, ids[i], *(v[x:y][order] for v in (pos, first, goes, comes)))
                    pair = [gram_hashes(own, WINDOW, seed)[open_].view(np.int64) if len(open_) else open_ for seed in (13, 14)]
                    for column, v in zip(out, (*runs_of(sure), open_, *pair)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], *(pa.array(c, pa.list_(pa.int64())) for c in out)], names=["id", "text_key", "text", "run_start", "run_length", "start", "hash_a", "hash_b"])

    return prepared.mapInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["id"] == b["id"]) & (a["text_key"] == b["text_key"])


def exact_copies(scanned: DataFrame) -> DataFrame:
    """(id, text_key, n_words) of documents whose whole word sequence a document with a smaller id has: all their windows repeat."""
    words = scanned.where(f"id is not null and n_words >= {WINDOW}")
    firsts = saved(words.groupBy("sha", "n_words").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "n_words", "first"), "originals")
    return saved(words.select("id", "text_key", "sha", "n_words").join(firsts.hint("merge"), ["sha", "n_words"]).where("id > first").select("id", "text_key", "n_words"), "copies")


def repeated_windows(keyed: DataFrame, scanned: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, text_key, text, run_start, run_length, starts): documents, but for exact copies, with windows that start in a document with a smaller id."""
    # Anchors that several documents have; partial sums come before the shuffle, so a common passage is no hot key.
    originals = scanned.where("id is not null").join(copies.hint("merge"), ["id", "text_key"], "left_anti")
    before = F.when(F.size("next") > 0, F.concat(F.array(F.lit(int(END.view(np.int64)))), F.slice("next", 1, F.size("next") - 1))).otherwise(F.col("next"))
    each = originals.select("id", "text_key", F.explode(F.arrays_zip("pos", "kmer", "next", before.alias("prev"))).alias("a"))
    stats = (
        each.groupBy(F.col("a.kmer").alias("kmer"))
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("a.next").alias("n0"), F.max("a.next").alias("n1"), F.min("a.prev").alias("p0"), F.max("a.prev").alias("p1"))
        .where("first < last")
        .select("kmer", "first", F.expr("n0 = n1").alias("goes"), F.expr("p0 = p1").alias("comes"))
    )
    stats = saved(stats, "repeated")  # as a table, so that adaptive execution can split the join below
    places = each.select("id", "text_key", F.col("a.kmer").alias("kmer"), F.col("a.pos").alias("pos"))
    flags = places.join(stats.hint("merge"), "kmer").groupBy("id", "text_key").agg(F.collect_set(F.struct("pos", "first", "goes", "comes")).alias("flags"))
    flagged = saved(_windows(keyed.join(flags.hint("merge"), ["id", "text_key"])), "windows")
    opened = flagged.select("id", "text_key", F.explode(F.arrays_zip("start", "hash_a", "hash_b")).alias("w")).select("id", "text_key", "w.*")
    firsts = opened.groupBy("hash_a", "hash_b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash_a", "hash_b", "first")
    firsts = saved(firsts, "firsts")
    late = opened.join(firsts.hint("merge"), ["hash_a", "hash_b"]).where("id > first").groupBy("id", "text_key").agg(F.collect_set("start").alias("starts"))
    return flagged.select("id", "text_key", "text", "run_start", "run_length").join(late.hint("merge"), ["id", "text_key"], "left").where("size(run_start) > 0 or starts is not null")


def kept_words(n: int, run_start: np.ndarray, run_length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each of n words is outside of all the windows."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, run_start, 1)
    np.add.at(edges, run_start + run_length - 1 + WINDOW, -1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return np.cumsum(edges[:n]) == 0


def cut(text: str, kept: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """The text without the words that go, each with the white space up to the next word."""
    out, at = [], 0
    for i in np.flatnonzero(~kept):
        start, end = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(text)
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]


def removals(keyed: DataFrame, scanned: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document that loses words: id, text_key, n_removed, kept_sha256[, kept_text]."""
    copies = exact_copies(scanned)
    repeated = repeated_windows(keyed, scanned, copies)
    id_type = repeated.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, text_key bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, *lists in zip(*(c.to_pylist() for c in batch.columns[2:])):
                spans = [m.span() for m in word.finditer(text)]
                kept = kept_words(len(spans), *(np.array(v or [], np.int64) for v in lists))
                removed.append(int((~kept).sum()))
                digests.append(hashlib.sha256(" ".join(text[a:b] for (a, b), k in zip(spans, kept) if k).encode()).hexdigest())
                if with_text:
                    texts.append(cut(text, kept, spans))
            columns = [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    whole = copies.select("id", "text_key", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *[F.lit("").alias("kept_text")] * with_text)
    return repeated.mapInArrow(run, schema).union(whole).dropDuplicates(["id", "text_key"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256.

    A word goes if a run of WINDOW words that covers it also starts in a document with a smaller id; runs are judged
    on the input. A null text has no words. A row without an id keeps all its words and takes none from others;
    rows that share an id take none from one another and are judged each on its own text. An empty table gives an empty
    result. Other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    scanned = saved(_scan(keyed), "anchors")
    gone = removals(keyed, scanned)
    every = scanned.select("id", "text_key", "sha", "n_words")
    return every.join(gone.hint("merge"), ["id", "text_key"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated words; a document that loses its last word goes, other columns stay as they are."""
    keyed = _keyed(docs, id_col, text_col)
    gone = removals(keyed, saved(_scan(keyed), "anchors"), with_text=True)
    gone = gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "kept_text")
    joined = docs.join(gone.hint("merge"), (docs[id_col] == F.col("_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_key")), "left")
    kept = joined.where("kept_text is null or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.select(*(F.coalesce("kept_text", docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns))
