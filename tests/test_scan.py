"""The segmented scan of sections against a walk line by line."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan

SECTIONS = ("usage", "cautions", "qr_url")
SCHEMA = "doc long, pos int, start string, identity boolean, structure boolean, free boolean, sure boolean, usage boolean, cautions boolean, qr_url boolean"


def walked(rows, tolerance):
    """What scan.going_on gives, by the state that lines leave behind."""
    out, active, gap, doc = {}, None, 0, object()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, 0, r[1])):
        d, pos, start, identity, structure, free, sure, *on = r
        if d != doc:
            doc, active, gap = d, None, 0
        told = None
        if start:
            active, gap = start, 0
        elif not identity:
            if active == "ingredients" and free and (sure or gap < tolerance):
                gap, told = (0 if structure else gap + 1), active
            elif dict(zip(SECTIONS, on)).get(active):
                told = active
            else:
                active, gap = None, 0
        out[d, pos] = told
    return out


def some_lines(seed, docs, longest, rare):
    r = random.Random(seed)
    rows = []
    for d in docs:
        for pos in range(r.randint(1, longest)):
            start = r.choice([*SECTIONS, "ingredients", "ingredients", "product_name"]) if r.random() < rare else None
            structure = r.random() < 0.2
            rows.append((d, pos, start, start is None and r.random() < 0.1, structure, r.random() < 0.97, structure or r.random() < 0.3, *(r.random() < 0.9 for _ in SECTIONS)))
    return rows


@pytest.mark.parametrize("seed, docs, longest, rare, tolerance", [(1, range(40), 30, 0.1, 3), (2, (1, None, 3), 900, 0.01, 3), (3, (7,), 4000, 0.004, 2), (4, (7, 8), 3000, 0.001, 0)])
def test_scan_in_blocks(spark, seed, docs, longest, rare, tolerance):
    rows = some_lines(seed, docs, longest, rare)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        on = {s: F.col(s) for s in SECTIONS}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        told = scan.going_on(df, ("doc",), ("pos",), F.col("start"), F.col("start").isNull() & ~F.col("identity"), F.col("structure"), F.col("free"), F.col("sure"), on, tolerance)
        got = {(x.doc, x.pos): x.active for x in told.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = walked(rows, tolerance)
    assert got == want
    assert any(want.values())


def test_scan_without_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scan.going_on(df, ("doc",), ("pos",), F.col("start"), F.col("start").isNull(), F.col("structure"), F.col("free"), F.col("sure"), {s: F.col(s) for s in SECTIONS}, 3).count() == 0
