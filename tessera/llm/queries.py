"""One query for each training-data operator, over its whole intended table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprints, infill, neardup, oracles, packing, quality, quotations, repair, secrets, sentencepieces, substring, topk, warc
from .common import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(read_table(spark, sf_dir, "conversations"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index,
        op2_substring_dedup,
        op3_sentencepiece_round_trip,
        op4_secret_scans,
        op5_best_fit_packing,
        op6_quality_classifier,
        op7_minhash_near_dedup,
        op8_exact_top_k,
        op9_document_fingerprints,
        op10_quotation_linking,
        op11_exact_dedup,
        op12_conversation_repair,
        op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": oracles.WARC,
    "op2_substring_dedup": oracles.SUBSTRING,
    "op7_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op8_exact_top_k": oracles.TOP_K,
    "op10_quotation_linking": oracles.QUOTATIONS,
    "op11_exact_dedup": oracles.EXACT,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
