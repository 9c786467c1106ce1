"""Facts that are looked up in tags and told only where they can be against the plain predicates, over label texts."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tests.labels import label_texts
from tessera.functions import tagging
from tessera.functions.arrays import replaced, strip
from tessera.functions.phrases import PHRASE_FACTS, Phrase, with_phrase_facts
from tessera.functions.predicates import FACTS, Line, split_tokens, token_like_name, with_facts
from tessera.functions.text import GLYPHS, SPACING, clean_text
from tessera.rules import LABELS, RAW

COMPOSED = ("label", "implicit", "product_name", "name_score", "list_score")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(label_texts())) + [(-1, None)], "id long, text string").repartition(4)


@pytest.mark.parametrize("rules", [LABELS, dataclasses.replace(LABELS, need_hangul=(), need_digit=())])
def test_line_facts(spark, texts, rules):
    facts, x = with_facts(texts, "text", rules)
    plain = Line(F.col("text"), dataclasses.replace(rules, need_hangul=(), need_digit=()))
    names = [n for level in FACTS for n in level if n not in ("hangul", "digit")] + list(COMPOSED)
    told = facts.select("id", *(getattr(x, n).alias(n) for n in names)).join(texts.select("id", *(getattr(plain, n).alias(f"p_{n}") for n in names)), "id").collect()
    assert len(told) == len(label_texts()) + 1
    for name in names:
        assert {r[name] == r[f"p_{name}"] for r in told} == {True}, name
        assert len({r[name] for r in told}) > 1, f"{name} is always the same"
    assert {r.label for r in told} == {None, "product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url"}
    assert {r.implicit for r in told} == {None, "capacity", "ingredients", "usage", "cautions", "effects", "others", "qr_url"}


def test_phrase_facts(spark, texts):
    facts, x = with_phrase_facts(texts, "text", RAW)
    plain = Phrase(F.col("text"), dataclasses.replace(RAW, need_hangul=(), need_digit=()))
    names = [n for level in PHRASE_FACTS for n in level if n not in ("hangul", "digit", "tokens")] + ["effect_hits", "effects", "candidate", "product_name", "label"]
    told = facts.select("id", *(getattr(x, n).alias(n) for n in names)).join(texts.select("id", *(getattr(plain, n).alias(f"p_{n}") for n in names)), "id").collect()
    for name in names:
        assert {r[name] == r[f"p_{name}"] for r in told} == {True}, name
        assert len({r[name] for r in told}) > 1, f"{name} is always the same"


def test_tokens_like_names(spark, texts):
    tokens = texts.select(F.explode(split_tokens(F.col("text"))).alias("t")).distinct()
    own = Line(F.col("t"), LABELS, token=True)
    told = tokens.select(token_like_name(F.col("t")).alias("a"), (~own.usage & ~own.caution & ~own.meta & F.col("t").rlike("[가-힣A-Za-z]")).alias("b")).collect()
    assert all(r.a == r.b for r in told) and len({r.a for r in told}) == 2


def test_clean_text_in_one_pass(spark, texts):
    one = [(a, b) for a, b in GLYPHS if len(a) == len(b) == 1]
    c = replaced(F.translate(F.coalesce("text", F.lit("")), "".join(a for a, _ in one), "".join(b for _, b in one)), [(a, b) for a, b in GLYPHS if not len(a) == len(b) == 1])
    for pattern, new in SPACING:
        c = F.regexp_replace(c, pattern, new)
    odd = spark.createDataFrame([(x,) for x in ("a,b", "a ,b", "a, b", "a:", ": a", "( a )", "a　b", "a\n", " a", "a  b", "a;\tb", "[ a", "a ]", "a,,b", ", ,", "a , ", "ok: yes, no; (x)")], "text string")
    told = texts.select("text").union(odd).select(clean_text(F.col("text")).alias("a"), strip(c).alias("b")).collect()
    assert [r.a for r in told] == [r.b for r in told]


def test_tags_without_the_library(monkeypatch):
    tags = tagging.word_tags(LABELS)
    fast = tags.tagger()
    monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    slow = tags.tagger()
    keys = [tagging.key_of(t) for t in label_texts()]
    assert [fast(k) for k in keys] == [slow(k) for k in keys]
    assert sum(slow(k)[1] > 1 for k in keys) > 10
    assert slow(tagging.key_of("사용 후 사용후"))[1] == 2  # two entries of the list, one key


def test_until_keyword(spark, texts):
    from tessera.functions.phrases import stop_words
    from tessera.functions.text import until_keyword

    words = stop_words(RAW)
    odd = spark.createDataFrame([(x,) for x in ("use", "use it use", "xuse", "주의 주의", "a\nuse", "☺☺ warning", "name.com", "lot lot exp")], "text string")
    for r in texts.select("text").union(odd).where("text is not null").select("text", until_keyword(F.col("text"), words).alias("cut")).collect():
        spots = [p for p in (r.text.lower().find(w.lower()) for w in words) if p > 0]
        assert r.cut == (r.text[: min(spots)].strip() if spots else r.text)
