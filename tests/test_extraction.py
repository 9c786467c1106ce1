"""Extraction from raw texts of printed labels, against results worked out by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera.operators import extraction, raw_sections, records

SCHEMA = "id long, text string, items string, label string"  # extra columns with names that the operators use


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(2)


def answers(df, name):
    return {r.id: r[name] for r in df.collect()}


def test_list_texts(spark):
    cases = {
        "전성분: 정제수글리세린추출물": "정제수, 글리세린, 추출, 물",  # the last word begins a name, so it is cut off
        "INGREDIENTS : Water ,Glycerin,,  PEG 8, 1 , 2 -Hexanediol, 9 ppm for": "Water, Glycerin, PEG-8, 1, 2-Hexanediol, 9ppm",
        "정제수, 글리세린, 판테놀, 베타인소듐": "정제수, 글리세린, 판테놀, 베타인소듐",
        "정제수 사용방법 적당량": "정제수",
        "": "", "※ ★": "",
    }
    got = answers(phrases.list_text(frame(spark, list(cases)), "text"), "text")
    assert [got[i] for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("words, after", [(phrases.NAME_ENDS, True), (phrases.NAME_STARTS, False)])
def test_words_taken_in_turn(words, after):
    """One pattern puts the commas where one replacement after another does."""
    r = random.Random(3)
    places = phrases.places_in_turn(words, after)
    places = re.compile(places + "(?=[가-힣A-Za-z0-9])" if after else "(?<=[가-힣a-zA-Z0-9])" + places)
    for _ in range(3000):
        text = "".join(r.choices([*words, "다이", "트라이", "가", "A1", " ", "소", "이디티에이", "색", "테트라"], k=r.randint(1, 6)))
        want = text
        for w in words:
            want = re.sub(f"({w})(?=[가-힣A-Za-z0-9])", r"\1, ", want) if after else re.sub(f"(?<=[가-힣a-zA-Z0-9])({w})", r", \1", want)
        assert places.sub(", ", text) == want


def test_ingredient_candidates(spark):
    cases = {
        "전성분: 정제수, 글리세린, 부틸렌글라이콜, 정제수, (판테놀)": ["정제수", "글리세린", "부틸렌글라이콜", "판테놀"],
        "Water; Glycerin; Panthenol": ["Water", "Glycerin", "Panthenol"],
        "Squalane · Betaine · 12 ml": ["Squalane"],  # link endings count wherever they stand, "ai" too
        "정제수글리세린": ["정제수", "글리세린"],
        "Squalane Betaine Panthenol": ["Squalane", "Panthenol"],
        "Niacinamide": ["Niacinamide"],
        "Water, alpha beta gamma delta epsilon zeta eta theta kappa lambda": ["Water", "alpha", "gamma", "delta", "epsilon", "theta", "kappa", "lambda"],
        "사용방법 적당량을 바릅니다": ["적당량을", "바릅니다"], "": None, "ab, 12, 02-123-4567": None,
    }
    rows = frame(spark, [*cases, None])
    got = answers(extraction.ingredient_candidates(rows, "id"), "items")
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())
    assert extraction.ingredient_candidates(rows.limit(0), "id").count() == 0


def test_amounts(spark):
    cases = {"내용량: 50 ㎖": "50ml", "용량 5 x 20 ml / 5x20ml": "20ml / 5 x 20ml", "제조번호 50 ml": "", "120g, 3 매": "120g / 3매", "no amount": "", "net 7 fl. oz": "7 fl. oz", "": ""}
    got = answers(extraction.amounts(frame(spark, [*cases, None]), "text"), "text")
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[len(cases)] == ""


def test_product_names(spark):
    cases = {
        "제품명: 수분 가득 크림": "수분 가득 크림", "Brand: Snow Cream": "Snow Cream", "브랜드: Snow Cream": "Snow Cream", "데일리 크림 보습감을 전달하여 좋은": "데일리 크림", "50 ml": None,
        "주의사항 있음. Soft Cream. A rather long sentence about nothing much": "Soft Cream.", "": None,
    }
    got = answers(extraction.product_names(frame(spark, [*cases, None]), "id", "text"), "name")
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())


def test_sentences(spark):
    usage = frame(spark, ["사용방법: 적당량을 덜어 바른다.\n적당량을 덜어  바른다.\n골고루 문지른다", "먼저 씻는다. 다음에 닦는다. 효능효과 보습에 좋다 용법 하루 두 번", "", None])
    got = answers(extraction.section_sentences(usage, "id", "text", "usage"), "items")
    assert got == {0: ["적당량을 덜어 바른다", "골고루 문지른다"], 1: ["먼저 씻는다. 다음에 닦는다", "하루 두 번"]}
    cautions = frame(spark, ["주의사항 1. 눈에 넣지 말 것 2. 상처에 쓰지 말 것", "눈에 넣지 말 것", "02-123-4567"])
    got = answers(extraction.section_sentences(cautions, "id", "text", "cautions"), "items")
    assert got == {0: ["1. 눈에 넣지 말 것", "2. 상처에 쓰지 말 것"], 1: ["눈에 넣지 말 것"]}


def test_links(spark):
    got = answers(frame(spark, ["see www . snow . co.kr/a, http : //x.com/y) and mail.example.org.", None]).withColumn("links", extraction.link_candidates(F.col("text"))), "links")
    assert got[0][:2] == ["http://x.com/y", "www.snow.co.kr/a"] and "mail.example.org" in got[0] and got[1] == []


LABEL = """제품명: Snow Cream
내용량 50ml
전성분: 정제수, 글리세린,
판테놀, 베타인
사용방법
적당량을 덜어 골고루 문지른다
주의사항: 눈에 넣지 말 것
www.snow.com
보습 진정 케어"""


def test_raw_sections(spark):
    docs = spark.createDataFrame([(1, LABEL), (2, "hello"), (3, None), (4, "아무 말\n정제수, 글리세린, 판테놀\n하나\n둘\n셋\n넷\n다섯")], "id long, raw_text string")
    lines = raw_sections.raw_lines(docs, "id")
    got = {(r.id, r.section): r.text for r in raw_sections.raw_sections(lines, "id").collect()}
    assert got[1, "product_name"] == "Snow Cream" and got[1, "capacity"] == "50ml" and got[1, "ingredients"] == "정제수, 글리세린, 판테놀, 베타인"
    assert got[1, "usage"] == "적당량을 덜어 골고루 문지른다" and got[1, "cautions"].startswith("눈에 넣지 말 것") and got[1, "qr_url"] == "www.snow.com"
    assert got[2, "product_name"] == "hello" and not any(i == 3 for i, _ in got)
    lists = answers(raw_sections.list_in_raw_text(lines, "id"), "text")
    assert lists[1] == "정제수, 글리세린, 판테놀, 베타인" and lists[4] == "정제수, 글리세린, 판테놀 하나 둘 셋" and 2 not in lists


def test_fields_and_records(spark):
    docs = spark.createDataFrame([(1, LABEL), (2, ""), (3, None)], "id long, raw_text string")
    detected = spark.createDataFrame([(1, "usage", "하루 두 번 바른다")], "id long, section string, text string")
    fields = records.extract_fields(docs, "id", detected=detected)
    got = {r.id: r for r in fields.collect()}
    assert (got[1].product_name, got[1].capacity, got[1].ingredients_raw) == ("Snow Cream", "50ml", ["정제수", "글리세린", "판테놀", "베타인"])
    assert got[1].usage == ["하루 두 번 바른다"] and got[1].urls == ["www.snow.com"]
    for i in (2, 3):
        assert (got[i].product_name, got[i].ingredients_raw, got[i].usage, got[i].urls) == ("확인 불가", [], ["확인 불가"], ["확인 불가"])
    results = spark.createDataFrame([(1, 0, True, "정제수", "정제수", 1.0, None), (1, 1, True, "정 제수", "정제수", 0.9, None), (1, 2, False, "글리", None, 0.4, "low")], "id long, pos int, matched boolean, ocr_name string, matched_name_kr string, similarity double, reason string")
    matched = records.match_records(results, "id")
    m = matched.first()
    assert (m.total_count, m.success_count, m.failed_count, m.normalized_count, m.status, m.verified_ingredient_names) == (3, 2, 1, 1, "partial_success", ["정제수"])
    assert [x.ocr_name for x in m.verified_ingredients] == ["정제수", "정 제수"] and [x.reason for x in m.unverified_ingredients] == ["low"]
    images = spark.createDataFrame([(1, 0, ["www.snow.com"], "x"), (1, 1, ["WWW.snow.com", "code 12345"], "visit http://a.org/b"), (2, 0, None, None)], "id long, no int, codes array<string>, text string")
    pages = spark.createDataFrame([("https://www.snow.com", "Snow", ""), ("http://a.org/b", "", "About")], "url string, page_title string, meta_description string")
    links = records.link_union(images, "id", "no", ("codes",), "text", pages)
    l1 = {r.id: r for r in links.collect()}
    assert l1[1].qr_codes == ["www.snow.com", "code 12345", "http://a.org/b", "a.org/b"] and l1[1].record.url == "https://www.snow.com" and (l1[1].page_title, l1[1].meta_description) == ("Snow", "About")
    assert l1[2].record.status == "not_detected"
    final = records.final_records(fields, records.validations(matched, "id"), links, "id", F.lit("2024-01-01 00:00:00"))
    flat = {r.user_id: r for r in records.flat_payload(final, "id").collect()}
    assert len(flat[1].__fields__) == 18 and flat[1].ingredients == ["정제수"] and flat[1].ingredient_match_rate == 33.33 and flat[1].ingredient_api_status == "partial_success"
    assert flat[2].ingredient_api_status == "not_run" and flat[2].ingredient_total_count == 0 and flat[3].qr_codes == []
    nested = records.nested_payload(final, "id", include_debug=True).where("id = 1").first().payload
    assert nested.result.product_name == "Snow Cream" and nested.ingredient_api_validation.unverified_count == 1 and nested.debug.ocr_meta.raw_text == LABEL
    outcomes = records.image_outcomes(images.select("id", "no"), images.where("no = 0").select("id", "no"), ("id", "no")).collect()
    assert sorted((r.id, r.no, r.success, r.error) for r in outcomes) == [(1, 0, True, None), (1, 1, False, "no result"), (2, 0, True, None)]
    assert records.candidate_records(fields, "id", "ingredients_raw").where("id = 1").first().candidate_count == 4
    assert records.extract_fields(docs.limit(0), "id").count() == 0


@pytest.mark.parametrize("text, ok", [("http://a.kr", True), ("abc", False), ("0123456789", False), ("02-123-4567", False), ("some code", True), ("확인 불가", False)])
def test_link_values(spark, text, ok):
    assert spark.range(1).select(phrases.valid_link_value(F.lit(text)).alias("v")).first().v is ok
