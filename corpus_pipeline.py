"""Corpus pipeline over `documents`: quality, near-dedup, substring dedup, secret scans, packing.

Each stage gets what its predecessor kept, as a stored table, and all but the last give the columns of documents. `run`
applies them in order. SQL can express neither the classifier nor the tokenizer, so ORACLE_SQL is None. The tests hold the
operators of the stages against brute force, and the pipeline as a whole against planted cases only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import neardup, packing, quality, secrets, substring
from tessera.llm.common import read_table, saved
from tessera.llm.queries import tokenizer_path


def with_size(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it; a null text has none."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones, does not reject."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that an earlier one has; what is left of a text keeps its white space."""
    return with_size(substring.without_repeats(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret, and what is linked to it, masked."""
    return with_size(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
