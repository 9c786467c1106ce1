"""What the findings of round 3 asked for, each by a test that failed before."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import phrases, text
from tessera.functions.arrays import distinct_rows, distinct_words
from tessera.operators import boxes, charsets, extraction, layout, lookup
from tessera.plans import queries
from tests.test_boxes_and_order import BOXES, chosen, some_boxes

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def stored(monkeypatch, module):
    """The labels of the tables that the module stores from here on, with their rows."""
    told, saved = {}, module.saved

    def counted(df, label):
        out = saved(df, label)
        told[label] = out.count()
        return out

    monkeypatch.setattr(module, "saved", counted)
    return told


@pytest.mark.parametrize("turned", [False, True])
def test_breaks_stand_before_all_lines_at_one_place(spark, turned):
    """whichever of the lines at one place comes in first, the blank line stands before the first of them by text."""
    rows = [(1, y, 1.0, 12.0, t) for y, t in ((10.0, "a"), (20.0, "b"), (30.0, "c"), (40.0, "d"), (50.0, "e"), (300.0, "y"), (300.0, "x"))]
    lines = spark.createDataFrame(rows[::-1] if turned else rows, "image_id long, center_y double, x_min double, height double, text string").coalesce(1)
    (told,) = layout.page_text(lines).collect()
    assert told.raw_text == "a\nb\nc\nd\ne\nx\ny" and told.layout_text == "a\nb\nc\nd\ne\n\nx\ny"


@pytest.mark.parametrize("few", [0, 8, 64])
def test_small_groups_of_boxes_need_no_cells(spark, monkeypatch, few):
    """groups of few boxes are settled in a row each, the others in cells, with one outcome."""
    told = stored(monkeypatch, boxes)
    rows = some_boxes(7, 300, 300, [1, 1, 1, 1, *range(2, 60)])
    df = spark.createDataFrame(rows, BOXES).repartition(4)
    kept = boxes.suppress(df, 0.6, few=few).drop("note").collect()
    assert sorted(map(tuple, kept), key=str) == [r for r in chosen(rows, 0.6)]
    small = spark.createDataFrame(rows, BOXES).where("image_index > 1")
    told.clear()
    boxes.suppress(small, 0.6).collect()
    assert "cells" not in told


def test_pages_are_decoded_in_small_batches(spark):
    """neither step on pages takes them in Arrow's batches of thousands of rows."""
    pages = spark.createDataFrame([(1, "가나".encode("euc-kr")), (2, "가나".encode()), (3, None)], "page_id long, content binary")
    told = charsets.with_decoded(pages)
    assert {(r.page_id, r.text, r.charset) for r in told.collect()} == {(1, "가나", "euc-kr"), (2, "가나", "utf-8"), (3, "", "utf-8")}
    assert "Arrow" not in plan(told) and "BatchEvalPython" in plan(told)


def test_distinct_words_are_told_apart_in_their_row(spark):
    """only rows that share an id and long texts go by rows, with the same words."""
    texts = ["b A a B  c", "", None, "x X", "x\ny", " ", "É é e", "a " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "y x"), (None, "q")], "doc_id long, text string")
    got = sorted(map(tuple, distinct_words(docs.where("doc_id is null or doc_id <> 3"), "doc_id", "text", "[ \n]+", F.lower, 20).collect()), key=str)
    by_rows = {r[0]: r[1] for r in distinct_rows(docs, "doc_id", F.split("text", "[ \n]+"), F.lower).collect()}
    assert got == sorted(((i, by_rows.get(i) if i is not None else None) for i in (0, 1, 2, 4, 5, 6, 7, None)), key=str)
    twice = distinct_words(docs, "doc_id", "text", "[ \n]+", F.lower).where("doc_id = 3").collect()
    assert len(twice) == 2 and twice[0].items == twice[1].items and sorted(map(str.lower, twice[0].items)) == ["x", "y"]


def test_spellings_of_equal_names_are_worked_out_once(spark, monkeypatch):
    """F17."""
    told = stored(monkeypatch, lookup)
    n = queries.query_variants(spark, SF_DIR).count()
    names = spark.read.parquet(f"{SF_DIR}/part.parquet").select("p_name", "p_brand", "p_size").distinct().count()
    assert n == spark.read.parquet(f"{SF_DIR}/part.parquet").count() and told["variants"] == names


def test_many_words_are_looked_for_outside_of_patterns(spark):
    """a list's end is found word by word, in a pass that no pattern of all words walks."""
    told = phrases.list_text(spark.createDataFrame([("정제수, 물 사용방법 x",), ("사용방법 a 주의 b",), (None,)], "text string"), "text")
    assert "BatchEvalPython" in plan(told)
    words = ("ab", "abc", "bc", *(f"w{i}w" for i in range(20)))
    rows = spark.createDataFrame([(x,) for x in ("xabc", "ab x ab abc", "abcbc", "ABx", "bcabc", "", None, "☺x bc")], "text string")
    for r in rows.select("text", text.until_keyword(F.col("text"), words).alias("cut")).collect():
        spots = [p for p in ((r.text or "").lower().find(w) for w in words) if p > 0]
        assert r.cut == (r.text[: min(spots)].strip() if spots else r.text)


def test_labels_are_dealt_over_tasks(spark):
    """F8, F10, F14, F16, F18, F19."""
    assert "p_partkey" in plan(queries.labels(spark, SF_DIR)).split("Optimized Logical Plan")[1].split("RepartitionByExpression [")[1].split("]")[0]


def test_a_label_is_cut_by_one_pattern():
    """Not by a replacement a word."""
    assert str(text.section_label_removed(F.col("text"), F.col("label"))).count("regexp_replace") <= 14


def test_lists_are_stored_between_passes(spark, monkeypatch):
    """F1, F2."""
    told = stored(monkeypatch, extraction)
    docs = spark.createDataFrame([(1, "정제수, 글리세린, 판테놀"), (2, "water glycerin")], "id long, text string")
    got = {r.id: r["items"] for r in extraction.ingredient_candidates(docs, "id").collect()}
    assert got[1] == ["정제수", "글리세린", "판테놀"] and told["once"] == 2
