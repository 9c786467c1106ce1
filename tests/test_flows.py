"""Streams, caches, stage metrics, projections and charsets: stops and restarts, failures, odd values."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import projection
from tessera.operators import charsets, stages
from tessera.plans import queries
from tessera.sources import cache
from tessera.streaming import sessions

SF_DIR = "/root/testdata/sf0.001"


def test_labels_reach_every_section(spark):
    walked = {r.section for r in queries.label_walk(spark, SF_DIR).collect()}
    assert walked == {"product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url", "others"}
    counts = queries.label_line_counts(spark, SF_DIR).collect()
    assert {r.label for r in counts} == {"none", "product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url"} and {r.noise for r in counts} == {True, False}


# Streamed sessions.

IMAGES = "request_id string, image_index int, n_images int, at timestamp"
START = dt.datetime(2024, 1, 1)


def simulated(rows, wait_s, late_s):
    """Sessions of rows that come in order of time; those still open at the end are not told."""
    out, by_id = [], {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    newest = max(r[3] for r in rows)
    for key, own in by_id.items():
        open_ = None
        for _, index, n, at in sorted(own, key=lambda r: (r[3], r[1])):
            if open_ is None or (at - open_["first"]).total_seconds() > wait_s:
                if open_ and not open_["told"]:
                    out.append((key, open_["first"], open_["last"], open_["n"], len(open_["seen"]), "timed out"))
                open_ = {"first": at, "last": at, "n": n, "seen": set(), "told": False}
            if not open_["told"] and index not in open_["seen"]:
                open_["seen"].add(index)
                open_["last"] = at
                if len(open_["seen"]) >= open_["n"]:
                    out.append((key, open_["first"], at, open_["n"], len(open_["seen"]), "complete"))
                    open_["told"] = True
        if open_ and not open_["told"] and open_["first"] + dt.timedelta(seconds=wait_s) < newest - dt.timedelta(seconds=late_s):
            out.append((key, open_["first"], open_["last"], open_["n"], len(open_["seen"]), "timed out"))
    return sorted(out)


def some_images(seed, n=300):
    r, at, rows = random.Random(seed), START, []
    for _ in range(n):
        at += dt.timedelta(seconds=r.randint(1, 120))
        rows.append((f"r{r.randint(0, 11)}", r.randint(0, 4), 3, at))
        if r.random() < 0.2:
            rows.append(rows[-1])  # sent twice
    return rows


@pytest.mark.parametrize("stops", [[], [70], [40, 41, 200]])
def test_sessions_after_stops(spark, tmp_path, stops):
    """Runs over what has come so far, each taken up from the checkpoint: the same results, once each."""
    rows = some_images(1)
    inbox, outbox, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for start, end in zip([0, *stops], [*stops, len(rows)]):
        spark.createDataFrame(rows[start:end], IMAGES).coalesce(1).write.mode("append").parquet(inbox)
        sessions.run_sessions(spark, inbox, outbox, checkpoint, IMAGES, "30 minutes", "1 minute")
    got = sorted(tuple(r) for r in spark.read.schema(sessions.RESULT).parquet(outbox).collect())
    assert got == simulated(rows, 1800, 60)
    assert {r[5] for r in got} == {"complete", "timed out"}
    again = sessions.run_sessions(spark, inbox, outbox, checkpoint, IMAGES, "30 minutes", "1 minute")
    assert sorted(tuple(r) for r in again.collect()) == got


def test_sessions_leave_incomplete_rows_out(spark, tmp_path):
    spark.createDataFrame([(None, 0, 1, START), ("a", None, 1, START), ("a", 0, None, START), ("a", 0, 1, None), ("b", 0, 1, START)], IMAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = sessions.run_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), IMAGES, "1 hour", "1 minute").collect()
    assert [(r.request_id, r.outcome) for r in found] == [("b", "complete")]


# The cache.


def test_cache_asks_once(spark, tmp_path):
    asked = []

    def ask(keys):
        told = sorted(r.name for r in keys.collect())
        asked.append(told)
        return keys.where("name <> 'nobody'").select("name", F.length("name").alias("n"))

    known = cache.LookupCache(spark, f"file://{tmp_path}/cache", "name", "n int")
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    first, n = known.look_up(names("a", "bb", "a", None, "nobody"), ask)
    assert n == 3 and sorted(map(tuple, first.collect())) == [("a", 1, 1), ("bb", 2, 1)]
    second, n = known.look_up(names("bb", "ccc", "nobody"), ask)
    assert n == 2 and sorted(map(tuple, second.collect())) == [("bb", 2, 1), ("ccc", 3, 2)]
    before = sorted(map(tuple, known.answers().collect()))
    (tmp_path / "cache" / "new-000009").mkdir()  # a version that was never finished
    assert known.versions() == [1, 2] and known.compact() == 3 and known.versions() == [3]
    assert sorted(map(tuple, known.answers().collect())) == before
    third, n = known.look_up(names("a", "bb", "ccc"), ask)
    assert n == 0 and third.count() == 3 and asked == [["a", "bb", "nobody"], ["ccc", "nobody"]]
    assert cache.LookupCache(spark, f"file://{tmp_path}/other", "name", "n int").answers().count() == 0


# Stage metrics.


def test_stages_tell_failures(spark):
    flow = stages.Stages(spark)
    rows = flow.run("made", spark.range(10).withColumn("error", F.when(F.col("id") % 3 == 0, "odd")), "error")
    with pytest.raises(Exception, match="boom"):
        flow.run("spoilt", rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.lit("x")).alias("x")))
    flow.run("empty", rows.where("id < 0"), "error")
    told = flow.metrics().collect()
    assert [(r.stage, r.n_rows, r.n_errors) for r in told] == [("made", 10, 4), ("spoilt", None, None), ("empty", 0, 0)]
    assert "boom" in told[1].failure and told[0].failure is None and all(r.seconds > 0 for r in told)
    assert flow.report().splitlines()[0].startswith("1. made: 10 rows, 4 with errors") and "failed" in flow.report()


# Projection.

ANSWERS = (
    None, "", "no braces", "[1, 2]", "{}", '{"product_name": 5, "ingredients": true}', '{"product_name": ["N/A", " x "], "ingredients": ["b", "b ", null, "NONE", 1.5]}', '{"product_name": [[1]], "ingredients": {"a": 1}}',
    '{"product_name": null, "ingredients": []}', '{"product_name": " 확인 불가 ", "ingredients": "one"}', '```json\n{"product_name": "a{b}", "confidence": "0.5"}\n```', '{"confidence": [1]}', '{"confidence": "x"}', '{"confidence": null, "extra": 1}', '{“product_name”: “q”,}',
)


def by_hand(raw):
    fields = {"product_name": "확인 불가", "ingredients": [], "confidence": None}
    if raw is None or not raw.strip():
        return (False, *fields.values(), [], "no answer")
    inner = raw[raw.find("{") : raw.rfind("}") + 1]
    parsed = None
    for text in (inner, inner.translate(str.maketrans("“”", '""')).replace(",}", "}")):
        try:
            parsed = json.loads(text)
            break
        except ValueError:
            continue
    if not isinstance(parsed, dict):
        return (False, *fields.values(), [], "no JSON object")
    misfits = []
    for name, kind in (("product_name", "text"), ("ingredients", "list"), ("confidence", "number")):
        v = parsed.get(name)
        if kind == "number":
            try:
                fields[name] = None if v is None else float(v)
            except (TypeError, ValueError):
                misfits.append((name, kind))
            continue
        items = [] if v is None else v if isinstance(v, list) else [v]
        texts = list(dict.fromkeys(t for t in (str(x).lower() if isinstance(x, bool) else str(x).strip() for x in items if x is not None and not isinstance(x, (dict, list))) if t.lower() not in projection.NOTHING))
        fields[name] = texts if kind == "list" else (texts or ["확인 불가"])[0]
        if any(isinstance(x, (dict, list)) for x in items):
            misfits.append((name, kind))
    return (True, *fields.values(), misfits, None)


def test_projection(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "id int, raw string")
    told = rows.select("id", projection.answers(F.col("raw"), {"product_name": "text", "ingredients": "list", "confidence": "number"}).alias("a")).select("id", "a.*").orderBy("id").collect()
    assert [(r.success, r.product_name, r.ingredients, r.confidence, [(m.field, m.expected) for m in r.misfits], r.error) for r in told] == [by_hand(x) for x in ANSWERS]


# Charsets.


def test_charsets(spark):
    korean, french = "뉴스 새로운 제품 안내 123", "ê ë français à côté"
    rows = [(1, korean.encode()), (2, korean.encode("euc-kr")), (3, french.encode()), (4, b""), (5, None), (6, b"plain"), (7, korean.encode("euc-kr") + b"\xff"), (8, korean.encode()[:-1])]
    told = {r.id: (r.text, r.charset) for r in charsets.with_decoded(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert told[1] == (korean, "utf-8") and told[2] == (korean, "euc-kr") and told[3] == (french, "utf-8") and told[4] == told[5] == ("", "utf-8") and told[6] == ("plain", "utf-8")
    assert told[7] == (korean + "\ufffd", "euc-kr") and told[8][1] == "utf-8" and told[8][0].startswith(korean[:-1])
    broken = korean.encode().decode("latin-1")
    assert [r.b for r in spark.createDataFrame([(broken,), (korean,)], "t string").select(charsets.looks_broken(F.col("t")).alias("b")).collect()] == [True, False]
