"""Best-fit packing of token sequences by length-histogram planning.

Only the histogram of piece lengths, at most `size` numbers, reaches the driver. Best-fit decreasing runs over
those counts: bins that hold the same fill form one group, a length fills whole groups at a time, and the plan is a
short table of runs. Pieces then take their slots by a join on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices, utf8
from .wordtable import MOST_BYTES, WordTable

SIZE = 2048
#: A part of the rows of one length that are ranked by one sort holds about so many of them, whatever their number.
RANK_ROWS = 200_000

#: Bytes that are white space alone or, in UTF-8, begin it; space and line feed are told apart by their neighbours.
ODD_BYTE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
WIDE_SPACES = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
WIDE_BYTE = np.isin(np.arange(256), [s[0] for s in WIDE_SPACES])

#: Fixed value: how the byte-level tokenizer splits a text before its merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAMPLE = ["It's a  test,\n\n of 12 words\tand über-naïve ÀÉ 東京.", " x", "don't", "\u00ad\u200b x 1٣", ""]

_tokenizers: dict = {}


@dataclass(frozen=True)
class Run:
    """Items of `length` with ranks from first_rank on: `each` of them in every sequence from first_sequence on, after `fill` tokens."""

    length: int
    first_rank: int
    each: int
    first_sequence: int
    fill: int


def plan_best_fit(counts: dict[int, int], size: int = SIZE) -> tuple[list[Run], int]:
    """Runs, by length and first rank, and the number of sequences; counts: items by length, 1 to size.

    Longer items first; each goes to the fullest sequence that it fits, as best-fit decreasing does. A sequence that
    has just taken an item is the fullest fit again while there is room, so a group of m equal sequences takes
    floor(room / length) items each, and splits at most once a length.
    """
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), by room
    runs: list[Run] = []
    sequences = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 1 <= length <= size:
            raise ValueError(f"a length of {length} is not from 1 to {size}")
        left, rank, made = counts[length], 0, []
        while left:
            at = bisect.bisect_left(groups, (length, -1, -1))
            if at < len(groups):
                room, first, number = groups.pop(at)
            else:
                room, first, number = size, sequences, -(-left // (size // length))
                sequences += number
            each = room // length
            full, rest = min(number, left // each), 0
            if full < number:
                rest = left - full * each
            runs.append(Run(length, rank, each, first, size - room))
            used = full + (rest > 0)
            if full:
                made.append((room - each * length, first, full))
            if rest:
                made.append((room - rest * length, first + full, 1))
            if number > used:
                made.append((room, first + used, number - used))
            taken = full * each + rest
            left, rank = left - taken, rank + taken
            for group in made:
                if group[0]:
                    bisect.insort(groups, group)
            made = []
    return sorted(runs, key=lambda r: (r.length, r.first_rank)), sequences


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Token bytes by id; byte-level files write each byte as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


class WordEncoder:
    """Ids of texts, by the words of a whole batch at once; words are remembered across batches.

    A space or line feed that stands alone between visible characters always begins a new word of a byte-level
    tokenizer, so the ids of such a text are those of its words: equal words of a batch are found by the hashes of
    their bytes, compared, and encoded once. Texts with other white space, or special tokens, are encoded whole. Encoding is done
    from the same file by tiktoken, which is quicker on short strings, if both libraries agree on SAMPLE; else by tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        ranks = {b: i for b, i in byte_ranks(spec["model"]["vocab"]).items() if b not in self.special}
        try:
            self.quick = tiktoken.Encoding("words", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            if any(self.quick.encode_ordinary(t) != self.tokenizer.encode(t, add_special_tokens=False).ids for t in SAMPLE):
                self.quick = None
        except Exception:  # not a byte-level vocabulary
            self.quick = None
        self.table = WordTable(lambda words: list(map(self.ids_of, words)))

    def ids_of(self, data: bytes) -> list[int]:
        if self.quick is None or any(s in data for s in self.special):
            return self.tokenizer.encode(data.decode(), add_special_tokens=False).ids
        return self.quick._core_bpe.encode_ordinary(data.decode())

    def odd_rows(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> set[int]:
        """Rows that hold white space other than single spaces and line feeds between visible characters, or special tokens."""
        where = [np.flatnonzero(ODD_BYTE[data])]
        for first in np.flatnonzero(WIDE_BYTE[data]):
            if bytes(data[first : first + 2]) in WIDE_SPACES or bytes(data[first : first + 3]) in WIDE_SPACES:
                where.append(np.array([first]))
        at = np.flatnonzero(breaks)
        where.append(at[:-1][np.diff(at) == 1])
        full = np.flatnonzero(np.diff(offsets))
        edges = np.concatenate([offsets[:-1][full], offsets[1:][full] - 1])
        where.append(edges[breaks[edges]])
        whole = data.tobytes()
        for s in self.special:
            found = whole.find(s)
            while found >= 0:
                where.append(np.array([found]))
                found = whole.find(s, found + 1)
        return set((np.searchsorted(offsets, np.concatenate(where), "right") - 1).tolist())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a batch, given the rows' bytes and offsets from 0."""
        rows = len(offsets) - 1
        if self.quick is None:
            return [np.array(self.ids_of(data[a:b].tobytes()), "<u4") for a, b in zip(offsets, offsets[1:])]
        breaks = (data == 32) | (data == 10)
        odd = self.odd_rows(data, offsets, breaks)
        breaks[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(breaks)
        ids, many = self.table.values(data, starts)
        bounds = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(starts, offsets)]
        return [np.array(self.ids_of(data[offsets[i] : offsets[i + 1]].tobytes()), "<u4") if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(rows)]


def word_encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and end_id: (id, piece, start, length, ids_crc32[, ids]).

    Longer documents are cut from the end, so only their first piece may be shorter than `size`.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, MOST_BYTES):
                where, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    own = np.append(own, end)
                    total = len(own)
                    cuts = [0, *range((total - 1) % size + 1, total + 1, size)]
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        where.append(i)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[x:y].tobytes()))
                        if keep_ids:
                            ids.append(own[x:y].astype(np.int64))
                columns = [batch.column(0).take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * keep_ids, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(pieces: DataFrame, id_col: str = "doc_id", size: int = SIZE, rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. The rows are read more than once: hand over a stored table.

    A length of n rows is ranked in n / rank_rows parts by hash, each part from where the earlier ones end.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_best_fit(histogram, size)
    by_length: dict[int, list[Run]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append(r)
    # At most `size` rows.
    plan = [(n, -(-histogram[n] // rank_rows), [(r.first_rank, r.each, r.first_sequence, r.fill) for r in own]) for n, own in by_length.items()]
    slots = spark.createDataFrame(plan, "length bigint, _parts bigint, _runs array<struct<first_rank:bigint,each:bigint,first_sequence:bigint,fill:bigint>>")
    part = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_parts")).cast("int")
    keyed = pieces.join(F.broadcast(slots.drop("_runs")), "length").withColumn("_part", part).drop("_parts")
    counts = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    # A row for each part: the number of rows in earlier parts of that length.
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    own_rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_own", own_rank).join(before.hint("merge"), ["length", "_part"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    run = F.element_at(F.filter("_runs", lambda r: r["first_rank"] <= F.col("_rank")), -1)
    placed = ranked.join(F.broadcast(slots.drop("_parts")), "length").withColumn("_run", run).withColumn("_in", F.col("_rank") - F.col("_run.first_rank"))
    return placed.select(
        *pieces.columns,
        (F.col("_run.first_sequence") + F.expr("_in div _run.each")).alias("sequence_id"),
        (F.col("_run.fill") + F.col("_in") % F.col("_run.each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Where each piece of each document goes: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives one piece that holds end_id alone. A null id stays null; repeated rows are
    packed once each; rows of equal length may swap places, which changes no sequence's fill. An empty table gives
    an empty result. Columns other than the two named ones are not read.
    """
    return pack(saved(token_pieces(docs, tokenizer_path, id_col, text_col, size, end_id), "pieces"), id_col, size)
