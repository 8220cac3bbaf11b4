"""Corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import bpe, decontaminate, neardup, pii, quality
from pagelake.llm.common import scratch, stored, table
from pagelake.llm.queries import tokens_digest


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that they share with the benchmark."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in place of every personal identifier."""
    return pii.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests that op10_bpe gives."""
    return tokens_digest(bpe.encode_texts(docs, bpe.vocabulary_path(), "doc_id"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", token_ids),
]

# Learned rules, sketches and tokenizer output are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each on the stored result of the one before.

    What a stage keeps on the way is removed once its result is stored.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
