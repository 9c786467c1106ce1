"""What F11, F22, F23 and F24 of round 3 asked for, each by a test that failed before."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.operators import layout, records, sections
from tessera.rules import SENTINELS


def test_lists_are_worked_out_once(spark):
    """what a list's items are made of is spelt out once, not again for each of them, with the same items."""
    assert str(arrays.clean_list(F.col("a"))).count("regexp_replace") == 1 and str(arrays.safe_list(F.col("a"))).count("regexp_replace") == 1
    assert str(text.with_scheme(F.col("a"))).count("regexp_replace") == 1
    r = random.Random(5)
    items = ["a", "A", " a ", "b c", "B\tC", "bc", "", " ", "　x ", None, *SENTINELS]
    lists = [[r.choice(items) for _ in range(r.randrange(6))] for _ in range(300)] + [None]

    def cleaned(xs):
        out = {}
        for x in xs or []:
            x = x and x.strip()
            if x and x not in SENTINELS:
                out.setdefault("".join(c for c in x.lower() if c not in " \n\r\t"), x)
        return list(out.values())

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, a array<string>")
    for row in rows.select("a", arrays.clean_list(F.col("a")).alias("c"), arrays.ordered_distinct(F.col("a")).alias("o")).collect():
        assert row.c == cleaned(row.a)
        firsts = {}
        for x in row.a or []:
            firsts.setdefault(x and "".join(c for c in x.lower() if c not in " \n\r\t"), x)
        assert row.o == (None if row.a is None else [x for k, x in firsts.items() if k])


def test_records_of_clean_links_clean_no_list_again(spark):
    """the links of a request are cleaned once for its record; structs are not sorted by an interpreted comparison."""
    images = spark.createDataFrame([(1, 0, ["www.a.com/x", "code", "CODE"]), (1, 1, [" www.a.com/x"]), (2, 0, None)], "id int, no int, codes array<string>")
    told = records.link_union(images, "id", "no", ("codes",))
    got = {x.id: x for x in told.collect()}
    assert got[1].qr_codes == ["www.a.com/x", "code"] and got[1].record.urls == ["https://www.a.com/x"] and got[1].record.raw_values == ["www.a.com/x", "code", "https://www.a.com/x"]
    assert got[2].qr_codes == [] and got[2].record.status == "not_detected"
    assert "array_sort" not in told._jdf.queryExecution().toString()


def test_lines_are_joined_in_their_rows(spark):
    """the words of a line meet in one row without windows over lines, and carry no points."""
    corners = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + 14.0), (x, y + 14.0)]
    words = [("i", 1, corners(60.0, 0.0, 50.0), "two", 0.9), ("i", 0, corners(0.0, 1.0, 50.0), "one", 0.9), ("i", 2, corners(110.5, 0.0, 40.0), "half", 0.9), ("i", 3, corners(0.0, 90.0, 50.0), "alone", 0.8)]
    df = spark.createDataFrame(words, "image_id string, ord int, points array<struct<x:double,y:double>>, text string, confidence double")
    lines = layout.lines_of_words(df)
    got = [(r.line_index, r.text, r.n_blocks, r.x_min, r.x_max) for r in lines.orderBy("line_index").collect()]
    assert got == [(0, "one twohalf", 3, 0.0, 150.5), (1, "alone", 1, 0.0, 50.0)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "points" not in plan.split("MapInArrow")[1].split("\n")[0]


def test_texts_are_joined_once_their_sections_are_settled(spark, monkeypatch):
    """no table that is stored on the way to the sections holds their texts a second time, with the same rows."""
    told, saved = {}, sections.saved
    monkeypatch.setattr(sections, "saved", lambda df, label: told.setdefault(label, df.columns) and saved(df, label))
    docs = spark.createDataFrame([(1, "제품명: 수분 크림\n전성분: 정제수, 글리세린\n아무 글"), (2, "water, glycerin, panthenol\nwww.a.com"), (3, "")], "doc_id long, text string")
    lines = sections.classified(layout.lines_of_text(docs, "doc_id"))
    got = sorted(map(tuple, sections.detect_sections(lines).collect()))
    assert "section_text" not in told["walked"] and "text" not in told["found"]
    found = sections.detect(lines)
    assert got == sorted(map(tuple, sections.with_others(sections.fill_missing(found, lines), lines).collect()))
