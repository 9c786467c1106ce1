"""Glyphs of recognised text and distinct variants, on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import clean_recognised
from tessera.operators.layout import distinct_variants


def test_glyphs_of_recognised_text(spark):
    wanted = {
        "▶전성분：정제수，글리세린": "전성분: 정제수, 글리세린", "Ⅳ・Ⅱ": "IV·II", "５０㎖ ★ １００％": "50ml 100%", "「주의」 “a” ‘b’": "[주의] \"a\" 'b'",
        "a→b●c": "a b·c", "( x ) ；y": "(x); y", "３㎤＿＆＋／": "3cm3_&+/", "": "", None: "",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "i int, t string").select("i", clean_recognised(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == list(wanted.values())


def test_first_of_each_variant_and_path(spark):
    rows = [("a", 2, "original", "p"), ("a", 1, "original", "p"), ("a", 3, None, None), ("a", 4, "unknown", ""), ("b", 1, "original", "p"), ("a", 5, "original", "q"), (None, 1, "x", "p"), (None, 0, "x", "p")]
    variants = spark.createDataFrame(rows, "image_id string, ord int, variant string, path string")
    got = {tuple(r) for r in distinct_variants(variants).collect()}
    assert got == {("a", 1, "original", "p"), ("a", 3, None, None), ("b", 1, "original", "p"), ("a", 5, "original", "q"), (None, 0, "x", "p")}
    assert distinct_variants(variants.limit(0)).count() == 0
