"""Suppression by grid cells, order statistics by counts: against plain loops, with one group that holds most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes, layout, order

BOXES = "image_index long, section_type string, x1 int, y1 int, x2 int, y2 int, confidence double, note string"


def overlap_of(a, b):
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / joint if joint > 0 else 0.0


def chosen(rows, least):
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r)
    out = []
    for own in groups.values():
        kept = []
        for r in sorted(own, key=lambda r: (-r[6], r[3], r[2])):
            if all(overlap_of(r[2:6], k[2:6]) < least for k in kept):
                kept.append(r)
        out += kept
    return sorted((r[:7] for r in out), key=str)


def some_boxes(seed, n, spread, images):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = r.randint(-20, spread), r.randint(0, spread), r.choice([3, 30, 40, 200]) + r.randint(0, 9), r.randint(20, 26)
        rows.append((r.choice(images), r.choice("ab"), x, y, x + w, y + h, round(r.random(), 6) + i * 1e-9, "n"))
    return rows + [(1, "a", 5, 5, 5, 9, 0.5, "n"), (1, "a", 5, 5, 5, 9, 0.5, "n"), (2, None, 0, 0, 9, 9, 0.5, "n"), (2, None, 0, 0, 9, 9, 0.4, "n"), (None, "a", 0, 0, 9, 9, 0.9, "n")]


@pytest.mark.parametrize("seed, n, spread, dense, least", [(1, 300, 120, 64, 0.75), (2, 150, 30, 12, 0.75), (5, 60, 2000, 64, 0.75)])
def test_suppression(spark, seed, n, spread, dense, least):
    rows = some_boxes(seed, n, spread, [1] * 5 + [2, 3])
    found = boxes.suppress(spark.createDataFrame(rows, BOXES).repartition(4), least, dense)
    assert found.columns == [x.split()[0] for x in BOXES.split(", ")]
    assert sorted((tuple(x)[:7] for x in found.collect()), key=str) == chosen(rows, least)


def test_suppression_of_nothing(spark):
    assert boxes.suppress(spark.createDataFrame([], BOXES)).count() == 0


@pytest.fixture
def many_blocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_statistics(spark, many_blocks):
    r = random.Random(5)
    rows = [(g, None if r.random() < 0.1 else round(r.gauss(0, 9), r.choice([0, 3]))) for g in [1] * 3000 + [2] * 7 + [None] * 50 + [4]] + [(5, None), (6, 2.0)]
    groups = defaultdict(list)
    for g, v in rows:
        groups[g] += [] if v is None else [v]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    got = {x.g: (x.n, x.a, x.b) for x in order.kth_values(df, ("g",), "v", {"a": lambda n: F.least(F.floor(n * 0.75), n - 1), "b": lambda n: F.lit(0)}).collect()}
    want = {g: (len(v), sorted(v)[min(int(len(v) * 0.75), len(v) - 1)], min(v)) for g, v in groups.items() if v}
    assert got == want
    middle = {x.g: x.median for x in order.medians(df, ("g",), "v").collect()}
    assert middle == {g: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for g, v in groups.items() if v}
    steps = sorted((x.g, x._step) for x in order.with_step(df.where("v is not null and g is not null"), ("g",), "v").collect() if x._step is not None)
    assert steps == sorted((g, b - a) for g, v in groups.items() if g is not None for a, b in zip(sorted(v), sorted(v)[1:]))


def test_section_break_of_a_long_image(spark, many_blocks):
    r = random.Random(6)
    rows = [(i, round(r.random() * 900, 1), float(j), r.choice([0.0, 10.0, 12.0])) for i, n in ((1, 2500), (2, 9), (3, 1)) for j in range(n)]
    want = {}
    for i in (1, 2, 3):
        ys, hs = sorted(x[1] for x in rows if x[0] == i), sorted(x[3] for x in rows if x[0] == i and x[3] > 0)
        gaps = sorted(b - a for a, b in zip(ys, ys[1:]) if b > a)
        h = (hs[(len(hs) - 1) // 2] + hs[len(hs) // 2]) / 2 if hs else layout.HEIGHT_DEFAULT
        want[i] = max(gaps[min(int(len(gaps) * 0.75), len(gaps) - 1)] * 1.5, h * 1.5) if gaps else h * 2.0
    found = layout.section_break(spark.createDataFrame(rows, "image_id long, center_y double, x_min double, height double").repartition(5))
    assert {x.image_id: round(x.threshold, 9) for x in found.collect()} == {k: round(v, 9) for k, v in want.items()}
