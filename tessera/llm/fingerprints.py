"""Document fingerprints by closed syncmers.

A k-mer of K code points is an anchor if the least of its inner S-mers lies at either edge. That depends on
the k-mer alone, so an edit changes no anchor outside of it, and the anchors of a spliced text are those of its pieces
and of the seam. A fingerprint covers all anchors with their positions by a digest, whatever the length of the text, and
lists the SKETCH smallest hashes besides. The likeness of two texts comes from all anchors, matched in order of position.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix, sliding

K, S = 16, 8
SKETCH = 64
#: How documents are dealt to tasks: characters of a text that cuts may look at, rows a part that cuts are chosen from and most of them in all, bytes of text a part, most parts.
HEAD, CUT_ROWS, MOST_CUT_ROWS, PART_BYTES, MOST_PARTS = 64, 32, 1_000_000, 64 << 20, 100_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; none in a text of fewer than k code points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = points.astype(np.uint64)
    inner = gram_hashes(values, s, 31)
    wide = k - s + 1
    least = sliding(inner, wide, np.minimum)
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[wide - 1 :]))
    # A k-mer's hash follows from those of the S-mers that tile it; the last one ends with it.
    out = inner[at]
    for step in [*range(s, k - s, s), k - s]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + inner[at + step])
    return at, out


def spliced(own: tuple[np.ndarray, np.ndarray], kept: int, other: tuple[np.ndarray, np.ndarray], taken: int, points: np.ndarray, other_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of points[:kept] + other_points[:taken], from the anchors of both; only the seam is hashed again."""
    a, b = max(0, kept - K + 1), min(taken, K - 1)
    seam_at, seam = anchors(np.concatenate([points[a:kept], other_points[:b]]))
    inside, after = own[0] + K <= kept, other[0] + K <= taken
    return np.concatenate([own[0][inside], seam_at + a, other[0][after] + kept]), np.concatenate([own[1][inside], seam, other[1][after]])


class Marks(NamedTuple):
    """All anchors of a text in order: positions, hashes, and how many characters each covers."""

    at: np.ndarray
    hashes: np.ndarray
    span: int


def sketch(hashes: np.ndarray, points: np.ndarray, at: np.ndarray | None = None) -> Marks:
    """All anchors with their positions; a text too short for an anchor has one hash of all of it, an empty one none."""
    if len(hashes):
        return Marks(anchors(points)[0] if at is None else at, hashes, K)
    whole = mix(gram_hashes(points.astype(np.uint64), len(points), 32)) if len(points) else np.zeros(0, np.uint64)
    return Marks(np.zeros(len(whole), np.int64), whole, len(points))


def smallest(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    if len(hashes) > 16 * size:  # enough to sort the smallest only
        low = np.unique(hashes[hashes < np.partition(hashes, 8 * size)[8 * size]])
        if len(low) >= size:
            return low[:size]
    return np.unique(hashes)[:size]


def pairs_of_equals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal hashes, ascending in a: the n-th occurrence of a hash in a with its n-th in b."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    (in_a, start_a, many_a), (in_b, start_b, many_b) = (np.unique(x[by], return_index=True, return_counts=True) for x, by in ((a, by_a), (b, by_b)))
    _, i, j = np.intersect1d(in_a, in_b, assume_unique=True, return_indices=True)
    n = np.minimum(many_a[i], many_b[j])
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = by_a[np.repeat(start_a[i], n) + step], by_b[np.repeat(start_b[j], n) + step]
    order = np.argsort(one)
    return one[order], two[order]


def rising(values: np.ndarray) -> np.ndarray:
    """Indices of a longest rising subsequence."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    ends, ends_at, before = [], [], []
    for i, v in enumerate(values.tolist()):
        n = bisect_left(ends, v)
        before.append(ends_at[n - 1] if n else -1)
        ends[n : n + 1], ends_at[n : n + 1] = [v], [i]
    out, i = [], ends_at[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


def collinear(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal hashes that rise in both: the common start and end, and a longest chain of pairs in between."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    i, j = pairs_of_equals(a[head : len(a) - tail], b[head : len(b) - tail])
    chain = rising(j)
    first, last = np.arange(head), np.arange(-tail, 0)
    return np.concatenate([first, i[chain] + head, last + len(a)]), np.concatenate([first, j[chain] + head, last + len(b)])


def covered(at: np.ndarray, span: int) -> int:
    """Characters that lie in any of the anchors at these ascending positions."""
    return int(np.minimum(np.diff(at), span).sum()) + span if len(at) else 0


def likeness(a: Marks, b: Marks) -> float:
    """Of the characters of both texts that anchors cover, the share under collinear matches; two empty texts are alike, an empty one and another are not."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    i, j = collinear(a.hashes, b.hashes)
    return (covered(a.at[i], a.span) + covered(b.at[j], b.span)) / (covered(a.at, a.span) + covered(b.at, b.span))


def as_string(marks: Marks) -> str:
    """SHA-256 of all anchors and their positions, then the SKETCH smallest distinct hashes for estimates between any two."""
    if not len(marks.hashes):
        return ""
    digest = hashlib.sha256(marks.hashes.astype(">u8").tobytes() + marks.at.astype(">i8").tobytes()).hexdigest()
    return digest + smallest(marks.hashes).astype(">u8").tobytes().hex()


def place(doc, head: str) -> tuple:
    """Where a row stands: nulls first, by id, then by the start of its text."""
    return (False, head) if doc is None else (True, doc, head)


def with_neighbours(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, guest, id, text) such that each part holds a stretch of documents in ascending id, and as guest the next stretch's first.

    One shuffle of the texts: stretches start at existing rows, so the first document of each is dealt to two parts.
    Null ids come first; rows that share an id, or have none, are ordered by text, and cut by the first HEAD characters
    of it, so that they spread over parts too. Cuts come from about CUT_ROWS random rows a part, MOST_CUT_ROWS at most; they
    decide on the size of parts and on nothing else. Without a number of parts there is one for PART_BYTES of text, or as many
    as shuffles have, but no more than MOST_PARTS; parts of a table of 100 TB hold about 1 GB, sorted on disk. The driver
    gathers ids and heads of at most a million rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = plain.select("id", F.substring("text", 1, HEAD).alias("head"))
    told = plain.agg(F.min(F.struct("id", F.substring("text", 1, HEAD))).alias("low"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    if partitions is None:
        partitions = min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(told["bytes"] or 0) // PART_BYTES)))
    low = told["low"] and place(*told["low"])
    share = min(CUT_ROWS * partitions, MOST_CUT_ROWS) / max(1, told["rows"])
    some = sorted(place(*row) for row in heads.where(F.rand(41) < share).collect()) if partitions > 1 else []
    cuts = sorted({some[i * len(some) // partitions] for i in range(1, partitions)} - {low}) if some else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [place(*x) for x in zip(batch.column(0).to_pylist(), pc.utf8_slice_codeunits(batch.column(1), 0, HEAD).to_pylist())]
            part = [bisect_right(cuts, x) for x in places]
            # Guests: the first of a stretch in the one before, the very first of all in the last.
            guests = [(i, len(cuts) if x == low else n - 1) for i, (x, n) in enumerate(zip(places, part)) if x == low or n and x == cuts[n - 1]]
            own = batch.take(pa.array([*range(len(batch)), *(i for i, _ in guests)], pa.int64()))
            numbers = pa.array([*part, *(n for _, n in guests)], pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, pa.array([False] * len(batch) + [True] * len(guests)), *own.columns], names=["part", "guest", "id", "text"])

    dealt = plain.mapInArrow(deal, f"part int, guest boolean, id {docs.schema[id_col].dataType.simpleString()}, text string")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document,
    in ascending id; after the last comes the first, and a single document follows itself. A null text counts as empty.
    Ids are integers or strings. Rows without an id come first, and rows that share an id follow one another by text. An empty table gives an empty
    result. Other columns are not read.
    """
    dealt = with_neighbours(docs, partitions, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def measured(text: str) -> tuple:
        points = code_points(text)
        found = anchors(points)
        return text, points, found, sketch(found[1], points, found[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one: id and what is measured
        part = None  # the part whose guest has been met

        def compared(own: tuple, after: tuple) -> tuple:
            (doc, (text, points, found, mine)), (_, other_points, other_found, others) = own, after
            taken = min(len(points) // 4, len(other_points))
            kept = len(points) - len(points) // 4
            edited = spliced(found, kept, other_found, taken, points, other_points)
            edited_points = np.concatenate([points[:kept], other_points[:taken]])
            changed = sketch(edited[1], edited_points, edited[0])
            digest = hashlib.sha256((text[:kept] + after[0][:taken]).encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(points), digest, as_string(mine), as_string(changed), likeness(mine, changed), likeness(mine, others)

        for batch in batches:
            out = []
            for p, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and part == p:
                    continue  # another row that shares the guest's id
                own = measured(text)
                if held is not None:
                    out.append(compared(held, own))
                held = None if guest else (doc, own)
                part = p if guest else part
            columns = list(zip(*out)) or [()] * 7
            types = [batch.schema.field(2).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return dealt.mapInArrow(run, f"{id_col} {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
