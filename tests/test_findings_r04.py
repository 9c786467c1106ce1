"""What the findings of round 4 asked for, each by a test that failed before."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessera.operators import extraction
from tests.test_findings_r03 import stored


def test_each_word_is_worked_out_once(spark, monkeypatch):
    """words of long texts meet a table of the distinct ones that are names; words of up to four letters are in no table."""
    told = stored(monkeypatch, extraction)
    docs = spark.createDataFrame([(i, "water glycerin and panthenol, the glycerin of panthenol from Somewhere. squalane") for i in range(5)], "id long, text string")
    got = {tuple(r["items"]) for r in extraction.ingredient_candidates(docs, "id").collect()}
    assert got == {("water glycerin panthenol", "glycerin", "panthenol", "Somewhere", "squalane")}
    assert told["word-names"] == 4 and told["words"] == 20 and "found" not in told


def test_texts_of_one_id_are_split_each_for_itself(spark):
    """that one text is a single name does not cost another text with the same id its words."""
    docs = spark.createDataFrame([(1, "glycerin of panthenol"), (1, "squalane"), (2, "ab cd")], "id long, text string")
    got = {r.id: sorted(r["items"]) for r in extraction.ingredient_candidates(docs, "id").collect()}
    assert got == {1: ["glycerin", "panthenol", "squalane"], 2: ["ab cd"]}


def test_links_are_looked_for_once_in_a_run(spark):
    """a run of characters that could be a domain is walked once, not from each of its places: seconds, not minutes, for a long one."""
    run = "ab-9" * 50_000
    short = spark.createDataFrame([("x_a.b.com/y z",), ("b.c_d.net.kr e",)], "text string").coalesce(1)
    assert [r[0] for r in short.select(extraction.link_candidates(F.col("text"))).collect()] == [["a.b.com/y"], ["d.net.kr"]]
    began = time.time()
    long = spark.createDataFrame([(run,), (f"{run} x_a.b.com/y z",)], "text string").coalesce(1)
    assert [r[0] for r in long.select(extraction.link_candidates(F.col("text"))).collect()] == [[], ["a.b.com/y"]] and time.time() - began < 30
