"""Matching keys of all lines, on a small fixture."""

from __future__ import annotations

from tessera.plans import queries


def test_line_keys_count_every_line(spark, tmp_path):
    docs = [(1, "en", "A b\na-B\nAB\nab\nlast"), (2, "en", "A b"), (3, "de", ""), (4, "de", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: (r.n_keys, r.n_spaceless, r.n_lines) for r in queries.line_keys(spark, str(tmp_path)).collect()}
    assert got == {"en": (2, 3, 5), "de": (1, 1, 1)}
