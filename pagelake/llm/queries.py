"""Queries of the operators, for the registry of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    decontaminate,
    filter_audit,
    fingerprint,
    language,
    language_model,
    manifest,
    neardup,
    oracles,
    pii,
    quality,
    revisits,
    vector_search,
)
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")) \
        .select("doc_id", "held_out", "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), "doc_id")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    base = pii.spans_text(F.col("base"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.spans_text(pii.all_spans()).alias("spans"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.headers_text(F.col("headers")))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.document_scores(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def tokens_digest(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_digest(bpe.encode_texts(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), "doc_id"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents")) \
        .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_pii": op2_pii,
        "op3_dart_minhash": op3_dart_minhash,
        "op4_role_repair": op4_role_repair,
        "op5_fingerprint": op5_fingerprint,
        "op6_decontaminate": op6_decontaminate,
        "op7_revisits": op7_revisits,
        "op8_recurrent_lm": op8_recurrent_lm,
        "op9_language": op9_language,
        "op10_bpe": op10_bpe,
        "op11_filter_audit": op11_filter_audit,
        "op12_one_bit_search": op12_one_bit_search,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
