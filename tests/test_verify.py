"""Matching of names against brute-force versions on small fixtures."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from tessera.operators import verify
from tessera.plans import queries
from tessera.rules import LABELS


def brute_score(x: str, y: str) -> float:
    far = abs(len(x) - len(y))
    factor = 0.78 if far >= 10 else 0.84 if far >= 8 else 0.90 if far >= 5 else 1.0
    return round(min((SequenceMatcher(None, x, y).ratio() + 0.10 * (x in y or y in x)) * factor, 1.0), 3)


def names_of(seed: int, n: int) -> list[str]:
    """Names of few letters, so that many are alike, with repeats, and perturbed copies."""
    r = random.Random(seed)
    plain = ["".join(r.choices("abcdef", k=r.randint(2, 24))) for _ in range(n)]
    cut = [x[: r.randint(1, len(x))] + "".join(r.choices("abcxyz", k=r.randint(0, 4))) for x in plain]
    return plain + cut + plain[: n // 4] + ["qqqq", "zzzzzzzzzzzzzzzz"]


def test_best_matches_against_difflib(spark):
    items, asked = names_of(1, 60), names_of(2, 60) + names_of(1, 20)
    r = random.Random(3)
    places = list(range(len(items)))
    r.shuffle(places)
    catalogue = spark.createDataFrame([(p, x, None, None) for p, x in zip(places, items)], "item_pos long, kor_name string, eng_name string, alias string")
    got = {x.query: x for x in verify.best_matches(spark.createDataFrame([(x,) for x in asked], "query string"), catalogue).collect()}
    matched = 0
    for q in set(asked):
        same = [p for p, x in zip(places, items) if x == q]
        score, place = (1.0, -min(same)) if same else max((brute_score(q, x), -p) for p, x in zip(places, items))
        if score >= LABELS.match:
            matched += 1
            assert (got[q].matched, got[q].item_pos, got[q].score) == (True, -place, score)
        else:
            assert q not in got
    assert 40 < matched < len(set(asked))


def keys_of(seed: int, n: int) -> list[str]:
    """Distinct keys over few and many letters: short ones, ones that hold others, ones with letters changed or moved, and long ones."""
    r = random.Random(seed)
    hangul = [chr(0xAC00 + 588 * i) for i in range(12)]
    plain = ["".join(r.choices(letters, k=r.randint(1, 22))) for letters in ("abcd", "abcdefghijkl", hangul) for _ in range(n)]
    spoilt = []
    for x in plain:
        y, at = list(x), r.randint(0, len(x) - 1)
        y[at : at + r.randint(0, 2)] = r.choices("xyz가", k=r.randint(0, 2))
        spoilt.append("".join(y))
    wider = [r.choice("pq") * r.randint(0, 4) + x + "rs" * r.randint(0, 5) for x in plain]
    turned = [x[len(x) // 2 :] + x[: len(x) // 2] for x in plain]
    return sorted({x for x in plain + spoilt + wider + turned if x} | {"a" * 210 + "b" * 30, "a" * 205 + "b" * 40, "ab" * 60})


def test_near_keys_loses_no_match(spark):
    asked, items = keys_of(1, 25), sorted(set(keys_of(2, 25)) | set(keys_of(1, 25)[::2]))
    left = spark.createDataFrame([(x,) for x in asked], "_qk string")
    right = spark.createDataFrame([(x, i) for i, x in enumerate(items)], "_ik string, item_pos long")
    for match, part_rows in ((LABELS.match, 20), (0.55, 20_000)):
        rows = verify.near_keys(left, right, match, part_rows).collect()
        met = {(r._qk, r._ik): r.least for r in rows}
        assert len(rows) == len(met)
        alike = {(x, y) for x in asked for y in items if x != y and brute_score(x, y) >= match}
        assert len(alike) > 150
        assert not alike - met.keys()
        assert any(x in y and SequenceMatcher(None, x, y).ratio() < match for x, y in alike)
        assert all(met[p] <= SequenceMatcher(None, *p).ratio() for p in alike)
        assert len(met) < len(asked) * len(items) / 2


def test_near_keys_of_nothing(spark):
    none = spark.createDataFrame([], "_qk string"), spark.createDataFrame([], "_ik string, item_pos long")
    one = spark.createDataFrame([("abc",)], "_qk string"), spark.createDataFrame([("abd", 1)], "_ik string, item_pos long")
    assert verify.near_keys(none[0], one[1], 0.6).count() == verify.near_keys(one[0], none[1], 0.6).count() == 0
    assert verify.near_keys(*one, 0.6).count() == 1


def test_fuzzy_matches_asks_every_part(spark, tmp_path):
    names = ["small ring", "red widget", "blue bolt", "hot gear", "small gizmo", "old bolt", "green widget"]
    part = [(i, names[i % 7]) for i in range(1, 36)]
    spark.createDataFrame(part, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r for r in queries.fuzzy_matches(spark, str(tmp_path)).collect()}
    assert sorted(got) == [k for k, _ in part]
    for k, name in part:
        asked = (name[:3] + "x" + name[4:]).replace(" ", "")
        score, place = max((brute_score(asked, n.replace(" ", "")), -p) for p, n in part)
        assert (got[k].matched, got[k].score, got[k].item_pos) == (score >= LABELS.match, score, -place)
