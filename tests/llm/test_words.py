"""The word table and the two encoders over it, against plain versions and the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import packing, sentencepieces, wordtable  # noqa: E402
from tessera.llm.common import read_table  # noqa: E402
from tessera.llm.queries import tokenizer_path  # noqa: E402

SIGNS = "abcde  \n\t.,éñ東한😀\x00<>()=0123AB▁'  "


def words_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdef", k=r.choice([1, 2, 3, 7, 30]))).encode() for _ in range(n)]


@pytest.mark.parametrize("hashes", [None, 1, 3])
@pytest.mark.parametrize("most", [0, 3000, 1 << 30])
def test_word_table(monkeypatch, hashes, most):
    """hashes: how many different ones there are, so that most words collide; most: how much is remembered."""
    if hashes:
        real = wordtable.WordTable.hashes
        monkeypatch.setattr(wordtable.WordTable, "hashes", lambda *a: real(*a) % np.uint64(hashes))
    monkeypatch.setattr(wordtable, "MOST_BYTES", 200)
    table = wordtable.WordTable(lambda words: [list(w[:5]) for w in words], most)
    for seed in range(6):
        words = words_of(seed % 3, 150) + [b"x" * 500] + words_of(7, 20)
        sizes = np.array([len(w) for w in words])
        values, many = table.values(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes)
        assert values.tolist() == [v for w in words for v in w[:5]] and many.tolist() == [min(len(w), 5) for w in words]
    assert table.values(np.zeros(0, np.uint8), np.zeros(0, np.int64))[0].tolist() == []


def odd_texts():
    r = random.Random(6)
    texts = ["".join(r.choices(SIGNS, k=r.randint(0, 50))) for _ in range(300)] + ["", None, " ", "▁", "▁▁ ▁a", "a" * 5000, "word " * 3]
    return texts + [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400_000))]


def test_round_trip_columns(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(odd_texts())) + [(0, "again"), (None, "no id"), (None, None)]
    want = []
    for d, t in rows:
        ids = sp.encode(t or "")
        back = sp.decode(ids)
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
    got = sentencepieces.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_unigram_scores():
    """The best sum of scores, against all ways to cut a word."""
    model = object.__new__(sentencepieces.Pieces)
    names = ["<unk>", *(sentencepieces.MARK + x for x in ("", "a", "ab")), "a", "b", "ab", "ba", "aba", "bb"]
    r = np.random.default_rng(1)
    model.pieces, model.merges, model.worst, model.apart = names, False, -30.0, {}
    model.ids = {p: i for i, p in enumerate(names) if i}
    model.scores = {p: -float(x) for p, x in zip(names[1:], r.integers(1, 20, len(names)))}
    model.backward = {}
    for piece, number in model.ids.items():
        node = model.backward
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = number

    def best(word):
        table = [0.0]
        for end in range(1, len(word) + 1):
            table.append(max(table[i] + (model.scores[word[i:end]] if word[i:end] in model.ids else -30.0) for i in range(end) if word[i:end] in model.ids or end - i == 1))
        return table[-1]

    words = sorted({sentencepieces.MARK + "".join(r.choice(list("abx"), r.integers(0, 9))) for _ in range(200)})
    for word, path in model.walk(words):
        texts = [model.text_of(n) for n in path]
        assert "".join(texts) == word and abs(sum(model.scores.get(t, -30.0) for t in texts) - best(word)) < 1e-9


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_ids_are_those_of_tokenizers(spark, table):
    """Whole test tables, and odd texts, some of more than two megabytes."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = [r.text or "" for r in read_table(spark, "/root/testdata/sf0.001", table).select("text").collect()]
    if table == "benchmark":
        texts += [t or "" for t in odd_texts()] + ["".join(random.Random(i).choices(SIGNS + "  ﹏̀²'ſdſ't", k=60)) for i in range(400)]
    encoder = packing.word_encoder(path)
    sizes = [len(t.encode()) for t in texts]
    ids = encoder.encode(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    for t, own in zip(texts, ids):
        assert own.tolist() == whole.encode(t, add_special_tokens=False).ids
