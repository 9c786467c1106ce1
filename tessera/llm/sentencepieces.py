"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

No piece goes on after a word's end, so a text's pieces are those of its marked words. The distinct marked words of a
batch are sorted, which is the depth-first order of their trie: each word keeps the forward table of the prefix that it
shares with the one before and extends it by the rest.

In a unigram model the forward score of a prefix is its best sum of piece scores. In a merge (BPE) model scores are ranks,
and a sum of them says nothing; there a path is allowed if each two neighbouring pieces stay apart when merged on their
own, and the one allowed path is the encoding. It is the forward table's entry, found and kept in the same way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices, utf8
from .wordtable import WordTable, spread

MARK = "▁"
MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
#: Pairs of pieces whose neighbourhood a Python worker remembers, and the bytes of texts handled at once.
MOST_PAIRS, BATCH_BYTES = 1_000_000, 1 << 21
#: What an unknown character costs below the worst piece in a unigram model.
UNKNOWN_COST = 10.0
#: Numbers of unknown characters, after those of all pieces, are below this.
NUMBERS = 1 << 21


class Pieces:
    """The vocabulary of a model file and the encoder over it.

    Pieces are numbered by their ids, and an unknown character by the size of the vocabulary and its code point.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation are handled")
        self.merges = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces that cross words are not handled")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        self.pieces = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN)
        told = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else " ⁇ ".encode() if p.type == p.UNKNOWN else b"" if p.type == p.CONTROL else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.told, self.told_size = np.frombuffer(b"".join(told), np.uint8), np.array([len(t) for t in told], np.int64)
        self.told_at = np.cumsum(self.told_size) - self.told_size
        # A trie of the pieces read backwards: children by character, and under "" the number of the piece that ends there.
        self.backward: dict = {}
        for piece, number in self.ids.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = number
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_COST
        self.apart: dict[int, bool] = {}
        self.table = WordTable(self.solve)

    def merged(self, text: str) -> list[str]:
        """The symbols of a short text after all merges: best score first, then leftmost."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def text_of(self, number: int) -> str:
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def number_of(self, character: str) -> int:
        found = self.ids.get(character)
        return len(self.pieces) + ord(character) if found is None else found

    def allowed(self, before: int, number: int) -> bool:
        """Whether a piece may follow another one (-1: nothing, at a start)."""
        key = before * NUMBERS + number
        if key not in self.apart:
            if len(self.apart) > MOST_PAIRS:
                self.apart.clear()
            first, second = self.text_of(before) if before >= 0 else "", self.text_of(number)
            self.apart[key] = self.merged(first + second) == ([first, second] if first else [second])
        return self.apart[key]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Numbers of the pieces of the sorted distinct words, depth-first over their trie."""
        last = [-1]  # last[i]: the last piece of the best path over the first i characters
        size = [0]  # and its length
        total = [0.0]
        previous = ""
        backward, apart, merges = self.backward, self.apart, self.merges
        scores = [self.scores.get(p, self.worst) for p in self.pieces]
        for word in words:
            shared = 0
            most = min(len(word), len(previous))
            if word[:most] == previous[:most]:
                shared = most
            else:
                while word[shared] == previous[shared]:
                    shared += 1
            del last[shared + 1 :], size[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Pieces that end here, by length.
                start, node, found = end, backward, []
                while start and (node := node.get(word[start - 1])) is not None:
                    start -= 1
                    if "" in node:
                        found.append((start, node[""]))
                if not found or found[0][0] != end - 1:
                    found.insert(0, (end - 1, self.number_of(word[end - 1])))
                if merges:
                    for start, number in reversed(found):
                        able = apart.get(last[start] * NUMBERS + number)
                        if self.allowed(last[start], number) if able is None else able:
                            break
                else:
                    best = -np.inf
                    for at, own in reversed(found):
                        score = total[at] + (scores[own] if own < len(scores) else self.worst)
                        if score > best:
                            best, start, number = score, at, own
                    total.append(best)
                last.append(number)
                size.append(end - start)
            previous, end, path = word, len(word), []
            while end:
                path.append(last[end])
                end -= size[end]
            yield word, path[::-1]

    def solve(self, words: list[bytes]) -> list[list[int]]:
        """Ids of the distinct words, given with spaces for marks."""
        texts = [w.decode("utf-8", "surrogatepass").replace(" ", MARK) for w in words]
        known, found = len(self.pieces), {}
        for text, path in self.walk(sorted(texts)):
            if max(path) >= known:
                path = list(chain.from_iterable([n] if n < known else self.spelt(chr(n - known)) for n in path))
            found[text] = path
        return [found[t] for t in texts]

    def spelt(self, character: str) -> list[int]:
        """Ids of an unknown character: those of its bytes, or the unknown one."""
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets from 0) of rows, given their UTF-8 bytes and offsets from 0; an empty row has no ids."""
        data, offsets = marks_as_spaces(data, offsets)
        full = offsets[:-1][np.diff(offsets) > 0]
        if self.prefix:
            data = np.insert(data, full, 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
            full = full + np.arange(len(full))
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[full] = True
        starts = np.flatnonzero(begins)
        ids, many = self.table.values(data, starts)
        return ids, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of rows of ids."""
        size = self.told_size[ids]
        data = self.told[spread(self.told_at[ids], size)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.prefix else texts


def marks_as_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space for each literal mark, as both are one symbol to the model."""
    at = np.flatnonzero(data == MARK_BYTES[0])
    at = at[(at + 2 < len(data))]
    at = at[(data[at + 1] == MARK_BYTES[1]) & (data[at + 2] == MARK_BYTES[2])]
    if not len(at):
        return data, offsets
    data = data.copy()
    data[at] = 32
    keep = np.ones(len(data), bool)
    keep[at + 1] = keep[at + 2] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): a null text counts as empty, which has no ids; ids and rows stay as they are, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                ids, bounds = pieces(model_path).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(id, text) of (id, ids); a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids = list_array(batch.column(1))
            texts = pieces(model_path).decode(ids.view(np.int64), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, text_col])

    listed = encoded.select(id_col, F.coalesce(F.col(ids_col).cast("array<bigint>"), F.array().cast("array<bigint>")))
    return listed.mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, {text_col} string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, exact.

    exact tells whether decoding gives the text back, which it does but for texts that hold the word mark itself. A null text
    counts as empty; repeated rows give repeated results and an empty table an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                own, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, bounds = model.encode(own, places)
                back = [t.encode() for t in model.decode(ids, bounds)]
                packed, whole = ids.astype("<u4").tobytes(), own.tobytes()
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([zlib.crc32(packed[4 * x : 4 * y]) for x, y in pairwise(bounds.tolist())], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                    pa.array([t == whole[x:y] for t, (x, y) in zip(back, pairwise(places.tolist()))], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pieces", "ids_crc32", "decoded_sha256", "exact"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean")
