"""Integers of words, solved once for equal words of a batch and remembered across batches.

Words are byte runs that tile a buffer. Equal ones are found by 64-bit hashes over whole arrays, and every
occurrence is compared with its word byte by byte, so a collision costs time and never a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd

from .common import mix, odd_constants

#: Bytes that either generation of remembered words may take, those of a word besides its own and its integers, and the most bytes handled at once.
MOST_REMEMBERED, ENTRY_BYTES, MOST_BYTES = 64 << 20, 140, 1 << 21


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    after = np.cumsum(sizes)
    return np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a[a_start : a_start + size] equals b[b_start : b_start + size], for each start; sizes are above 0."""
    if not len(sizes):
        return np.zeros(0, bool)
    equal = a[spread(a_start, sizes)] == b[spread(b_start, sizes)]
    return np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)


class Generation:
    """Words and their integers, both in pools; `known` gives a word's place by its hash."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.words, self.values = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.word_at = self.word_size = self.at = self.size = np.zeros(0, np.int64)

    def find(self, keys: list[int], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in data (-1: not here), and which keys are another word's."""
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        hit = np.flatnonzero(place >= 0)
        good = self.word_size[place[hit]] == sizes[hit]
        at = hit[good]
        good[good] = same_bytes(self.words, self.word_at[place[at]], data, starts[at], sizes[at])
        taken = np.zeros(len(keys), bool)
        taken[hit[~good]] = True
        place[taken] = -1
        return place, taken

    def add(self, words: np.ndarray, word_size: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Append words and their integers, given one after another; their places."""
        places = np.arange(len(size)) + len(self.size)
        self.word_at = np.concatenate([self.word_at, len(self.words) + np.cumsum(word_size) - word_size])
        self.word_size = np.concatenate([self.word_size, word_size])
        self.at = np.concatenate([self.at, len(self.values) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.words, self.values = np.concatenate([self.words, words]), np.concatenate([self.values, values])
        return places

    def taken(self) -> int:
        return len(self.size) * ENTRY_BYTES + len(self.words) + 4 * len(self.values)


class WordTable:
    """values() gives the integers of all words; `solve` those of new words (bytes), in their order.

    Two generations are kept: a word that is met again moves to the younger one, and once that is full it takes the
    place of the older one, whose other words are forgotten.
    """

    def __init__(self, solve: Callable[[list[bytes]], Sequence[Sequence[int]]], most_remembered: int = MOST_REMEMBERED):
        self.solve, self.most = solve, most_remembered
        self.young, self.old = Generation(), Generation()
        base = odd_constants(5, 1)[0]
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(MOST_BYTES + 1, base, np.uint64))
            self.inverse = np.cumprod(np.full(MOST_BYTES + 1, pow(int(base), -1, 1 << 64), np.uint64))
        self.letters = odd_constants(6, 256)

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.powers[: len(data)])])
            return mix((sums[starts + sizes] - sums[starts]) * self.inverse[starts] + sizes.astype(np.uint64))

    def values(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integers, how many each word has) of the words that begin at starts; the first at 0, each ends where the next begins."""
        parts = list(self._parts(data, starts))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return (parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts))))  # type: ignore[return-value]

    def _parts(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.append(starts[1:], len(data))
        a = 0
        while a < len(starts):
            b = int(np.searchsorted(ends, starts[a] + MOST_BYTES, "right"))
            if b <= a:  # a word of more than MOST_BYTES stands alone and is not remembered
                own = np.array(self.solve([data[starts[a] : ends[a]].tobytes()])[0], np.uint32)
                yield own, np.array([len(own)])
                a += 1
                continue
            yield self._part(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a])
            a = b

    def _part(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.append(starts[1:], len(data)) - starts
        codes, distinct = pd.factorize(self.hashes(data, starts, sizes))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        # A word unlike the first one of its hash stands for itself, under no key.
        like = sizes == sizes[first][codes]
        like[like] = same_bytes(data, starts[like], data, starts[first][codes[like]], sizes[like])
        other = np.flatnonzero(~like)
        codes[other] = len(first) + np.arange(len(other))
        keys = distinct.tolist()
        first = np.concatenate([first, other])
        at, size = starts[first], sizes[first]
        n = len(keys)
        place = np.full(len(first), -1)
        place[:n], taken = self.young.find(keys, data, at[:n], size[:n])
        nameless = np.concatenate([taken, np.ones(len(other), bool)])
        seek = np.flatnonzero(place[:n] < 0)
        older, _ = self.old.find([keys[i] for i in seek.tolist()], data, at[seek], size[seek])
        again, older = seek[older >= 0], older[older >= 0]
        self._keep(data, at, size, place, again, self.old.values[spread(self.old.at[older], self.old.size[older])], self.old.size[older])
        new = np.flatnonzero(place < 0)
        if len(new):
            lists = self.solve([data[a:b].tobytes() for a, b in zip(at[new].tolist(), (at + size)[new].tolist())])
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            self._keep(data, at, size, place, new, np.fromiter(chain.from_iterable(lists), np.uint32, int(many.sum())), many)
        self.young.known.update((keys[i], place[i]) for i in np.concatenate([again, new]).tolist() if not nameless[i])
        word, young = place[codes], self.young
        many = young.size[word]
        out = young.values[spread(young.at[word], many)], many
        if young.taken() > self.most:
            self.young, self.old = Generation(), young
        return out

    def _keep(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, which: np.ndarray, values: np.ndarray, many: np.ndarray) -> None:
        place[which] = self.young.add(data[spread(at[which], size[which])], size[which], values, many)
