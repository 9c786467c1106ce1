"""Texts of a million characters without an end, of one kind or of spaces alone: time grows with their length."""

import random
import re
import time

import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import quotations, secrets  # noqa: E402

N = 1_000_000
LONG = ("a" * N, " " * N, "a " * (N // 2), "x" + " " * N + "y", "user" + " " * N, "://" * (N // 3), "a://b " * (N // 6), "0" * N, "AKIA" * (N // 4), ">" * N, "\n" * N, "> " * (N // 2), "token=" * (N // 6))


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_secrets_of_long_texts(text):
    began = time.time()
    base, every = secrets.scan(text)
    secrets.redacted(text, every)
    assert time.time() - began < 10


def test_quotations_of_long_texts(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(LONG)] + [(i, 1, "assistant", f"> {t[:1000]}\nYes.") for i, t in enumerate(LONG)]
    began = time.time()
    found = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)).collect()
    assert len(found) == len(rows) and time.time() - began < 60


def test_endpoints_as_by_pattern():
    pattern = re.compile(r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._:@/?&%=-]+")
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choices(["://", "a", "b9", "9", "+", "-", " ", "Z", "/", ":"], k=r.randint(0, 14)))
        assert secrets.endpoints(text) == [(*m.span(), "endpoint") for m in pattern.finditer(text)]


def test_weak_spans_that_meet_base_spans_go():
    r = random.Random(4)
    parts = ["password=abcdef12", "AKIA" + "A" * 16, "user=bob", "https://a.b/c", "0123456789abcdef01234567", "Ab1" * 12, " ", "\n", "x" * 50]
    for _ in range(500):
        text = "".join(r.choices(parts, k=r.randint(1, 12)))
        base, weak = secrets.base_spans(text), secrets.weak_spans(text)
        want = {*base, *(s for s in secrets.linked(weak, base + weak) if not any(b[0] < s[1] and s[0] < b[1] for b in base))}
        assert set(secrets.scan(text)[1]) == want
