"""The flow of requests: failures by stage, optional parts, empty tables, saves that fail, and the job on files."""

import json

import pytest

from tessera import job
from tessera.functions.phrases import decoded_values
from tessera.functions.text import plain_name, splittable
from tessera.operators import flow, layout
from tessera.sources import readers, sinks
from pyspark.sql import functions as F

FIELDS = (
    "user_id string, image_index int, error string, raw_text string, confidence double, product_name string, capacity string, ingredients_raw array<string>, "
    "usage array<string>, cautions array<string>, effects array<string>, qr_codes array<string>, urls array<string>"
)
ITEMS = "item_pos int, kor_name string, eng_name string, alias string, cas_no string, definition string"


def image(user, index, names=(), error=None, product=None, codes=(), text=""):
    return (user, index, error, text, 0.5, product, None, list(names), [], [], [], list(codes), [])


REQUESTS = ['{"user_id": 1, "image_url": ["a", "b", "c"]}', '{"user_id": 2, "image_url": "a"}', '{"user_id": 3, "image_url": []}', "{", '{"user_id": 4, "image_url": "a"}']
READ = [
    image("1", 0, ["glycerin", "panthenol"], product="N/A", codes=['"www.a.com/x."', "123456", "02-123-4567"]), image("1", 1, error="dark"), image("1", 2, ["Glycerin", "glycerol stearate", "betaine"], product="Cream"),
    image("2", 0, error="blurred"), image("4", 0), image("9", 0, ["nobody asked"]),
]


@pytest.fixture(scope="module")
def tables(spark):
    asked = readers.requests(spark.createDataFrame([(b,) for b in REQUESTS], "body string"))
    items = spark.createDataFrame([(0, "glycerin", None, None, "56-81-5", None), (1, "panthenol", None, None, None, None), (2, None, "betaine", None, None, None)], ITEMS)
    return asked, spark.createDataFrame(READ, FIELDS), items


def test_flow(tables):
    done = flow.analyse(*tables)
    failures = {(r.user_id, r.stage, r.error) for r in done.failures.collect()}
    assert failures == {(None, "request", "not JSON"), ("3", "request", "no image_url"), ("2", "images", "no image could be analysed")}
    records = {r.user_id: r for r in done.records.collect()}
    assert set(records) == {"1", "4"}
    result = records["1"].result
    assert [(i.image_path, i.success, i.error) for i in result.debug_info.image_analysis_success] == [("a", True, None), ("b", False, "dark"), ("c", True, None)]
    assert result.product_name == "Cream" and result.ingredients_raw == ["glycerin", "panthenol", "glycerol stearate", "betaine"]
    assert [x.ocr_name for x in result.ingredient_api_validation.unverified_ingredients] == ["glycerol stearate"]
    assert result.ingredient_api_validation.verified_ingredients[0].cas_no == "56-81-5" and result.qr_info.urls == ["https://www.a.com/x"]
    assert records["4"].result.ingredient_api_validation.status == "not_run" and records["4"].accuracy.ingredient_match_rate == 0.0
    counts = {r.stage: (r.n_rows, r.n_errors) for r in done.stages.metrics().collect()}
    assert counts["requests"] == (5, 2) and counts["images"] == (5, 2) and counts["records"] == (2, 0) and counts["failures"] == (3, 0)


def test_flow_without_options_and_rows(spark, tables):
    asked, fields, items = tables
    plain = {r.user_id: r.result for r in flow.analyse(asked, fields).records.collect()}
    assert plain["1"].ingredient_api_validation.status == "not_run" and plain["1"].ingredients_verified == []
    answers = spark.createDataFrame([("1", True, "Told", "5 ml", ["u"], [], []), ("4", False, "No", None, [], [], [])], "user_id string, success boolean, product_name string, capacity string, usage array<string>, cautions array<string>, effects array<string>")
    told = {r.user_id: r.result for r in flow.analyse(asked, fields, answers=answers).records.collect()}
    assert (told["1"].product_name, told["1"].capacity, told["1"].usage) == ("Told", "5 ml", ["u"]) and told["4"].product_name != "No"
    empty = flow.analyse(asked.where("false"), fields.where("false"), items.where("false"))
    assert empty.records.collect() == [] and empty.failures.collect() == []


def test_job(spark, tables, tmp_path):
    asked, fields, items = tables
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join(REQUESTS))
    fields.write.parquet(f"{tmp_path}/fields")
    items.write.parquet(f"{tmp_path}/items")
    said = job.run(spark, f"{tmp_path}/in", f"{tmp_path}/fields", f"{tmp_path}/out", "r1", f"{tmp_path}/items")
    assert "payloads: saved" in said and "not saved" not in said
    sent = spark.read.json(f"{tmp_path}/out/stage=payloads").collect()
    assert {r.user_id: r.image_url for r in sent} == {"1": "a", "4": "a"}
    assert spark.read.json(f"{tmp_path}/out/stage=failures").count() == 3 and job.healthy(spark)


def test_saves_that_fail_are_told(spark):
    kept = []
    told = sinks.attempted(spark, {"bad": lambda: json.loads("{"), "good": lambda: kept.append(1)}).orderBy("position").collect()
    assert [(r.name, r.saved) for r in told] == [("bad", False), ("good", True)] and "JSONDecodeError" in told[0].error and kept == [1]


def test_names_and_values(spark):
    rows = spark.createDataFrame([("전성분：물，글리세린\r\n 5㎖ ； a–b\t c",), ("전 성분 성분: Ingredients  a  b 。.",), ("",), (None,), ("ingredients",), ("성분추출물",)], "t string")
    told = [tuple(r) for r in rows.select(splittable(F.col("t")), plain_name(F.col("t"))).collect()]
    assert told[0] == ("전성분: 물, 글리세린\n5ml; a-b c", "물,글리세린 5㎖ ; a–b c")
    # Labels go in their order, each once.
    assert told[1][1] == "a b 。"
    assert told[2] == told[3] == ("", "") and told[4][1] == "" and told[5][1] == "추출물"
    codes = spark.createDataFrame([(['<www.x.com/ a>.', "1234", "abc", "some long text", "확인 불가", None],), (None,)], "c array<string>")
    assert [r[0] for r in codes.select(decoded_values(F.col("c"))).collect()] == [["https://www.x.com/a", "some long text"], []]


def test_variant_summaries(spark):
    rows = [("i", 1, "a", "p", 0.5, 0.9, 3, None, "text"), ("i", 2, "b", "q", None, None, None, 2, None), ("i", 3, "c", "r", 0.5, 0.1, 1, 1, "")]
    told = layout.variant_summaries(spark.createDataFrame(rows, "image_id string, ord int, variant string, path string, score double, confidence double, n_blocks int, n_lines int, raw_text string")).orderBy("place").collect()
    assert [(r.place, r.variant, r.score, r.n_blocks, r.n_lines, r.text_length) for r in told] == [(1, "a", 0.5, 3, 0, 4), (2, "c", 0.5, 1, 1, 0), (3, "b", 0.0, 0, 2, 0)]
