"""Fingerprints of long texts, and matching by position."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import fingerprints as f  # noqa: E402


def marks(text):
    points = f.code_points(text)
    return f.sketch(f.anchors(points)[1], points)


def letters(seed, n):
    return "".join(random.Random(seed).choices("abcdefgh ", k=n))


def test_every_edit_of_a_long_text_shows():
    text = letters(1, 100_000)
    own = marks(text)
    assert f.likeness(own, own) == 1.0
    for at in range(0, 99_000, 9_000):
        other = marks(text[:at] + letters(at + 2, 1000) + text[at + 1000 :])
        assert f.as_string(other) != f.as_string(own) and abs(f.likeness(own, other) - 0.99) < 0.001
    passage = letters(3, 1000)
    shared = f.likeness(marks(letters(4, 50_000) + passage + letters(5, 49_000)), marks(letters(6, 20_000) + passage + letters(7, 79_000)))
    assert abs(shared - 0.01) < 0.001


def test_order_counts():
    a, b = letters(8, 6000), letters(9, 4000)
    assert abs(f.likeness(marks(a + b), marks(b + a)) - 0.6) < 0.01


def test_chain_is_a_longest_one():
    r = np.random.default_rng(1)
    for n in range(1, 60):
        v = r.permutation(n)
        best = []
        for i in range(n):
            best.append(1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0))
        chain = f.rising(v)
        assert len(chain) == max(best) and (np.diff(chain) > 0).all() and (np.diff(v[chain]) > 0).all()
    a, b = r.integers(0, 20, 80).astype(np.uint64), r.integers(0, 20, 70).astype(np.uint64)
    i, j = f.collinear(a, b)
    assert (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_anchors_against_every_kmer():
    """Each k-mer by itself: its least inner substring lies at an edge, whatever stands around it."""
    for text in (letters(10, 700), "ab" * 60, "a" * 50, "short", letters(11, f.K), "東京" * 20):
        points = f.code_points(text)
        at, hashes = f.anchors(points)
        found = dict(zip(at.tolist(), hashes.tolist()))
        for i in range(len(points) - f.K + 1):
            kmer = points[i : i + f.K]
            inner = [int(f.gram_hashes(kmer[j : j + f.S].astype(np.uint64), f.S, 31)[0]) for j in range(f.K - f.S + 1)]
            assert (i in found) == (min(inner) in (inner[0], inner[-1]))
            if i in found:
                assert found[i] == int(f.anchors(kmer)[1][0])


def test_likeness_against_all_chains():
    """The best rising matches of few anchors, found by trying all of them between the common ends."""
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = (r.integers(0, 5, r.integers(1, 9)).astype(np.uint64) for _ in range(2))
        i, j = f.collinear(a, b)
        longest = np.zeros((len(a) + 1, len(b) + 1), int)
        for x in range(len(a)):
            for y in range(len(b)):
                longest[x + 1, y + 1] = longest[x, y] + 1 if a[x] == b[y] else max(longest[x, y + 1], longest[x + 1, y])
        assert (a[i] == b[j]).all() and len(i) <= longest[-1, -1]
        assert len(set(a.tolist())) < len(a) or len(set(b.tolist())) < len(b) or len(i) == longest[-1, -1]


@pytest.mark.parametrize("name", ["bigint", "string"])
def test_a_third_of_all_rows_without_id_or_with_one_id_is_spread(spark, name):
    texts = [f"{i * 7919 % 300:03d} words that follow {i}" for i in range(300)]
    rows = [((None, "5", str(i))[i % 3], t) for i, t in enumerate(texts)]
    rows = [(int(d) if d and name == "bigint" else d, t) for d, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {name}, text string")
    sizes = [r["count"] for r in f.with_neighbours(docs, 10).where("not guest").groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 7 and max(sizes) < 75
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else rows[1][0], x[1]))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        m = len(t) // 4
        want.append((d, hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()))
    got = f.fingerprints(docs, partitions=10).select("doc_id", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
