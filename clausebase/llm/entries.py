"""The thin queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, language, lines, manifest, merkle, mixing, near, pii, quality, suffix, tokens
from .common import table


def op1_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_by_section(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing_to_weights, op2_pii_sanitisation, op3_merkle_fingerprints, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_line_dedup, op7_token_counts, op8_ngram_jaccard_join, op9_quality_resampling, op10_language_mixture, op11_byte_level_bpe, op12_conversation_repair, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing_to_weights": mixing.oracle_sql(),
        "op3_merkle_fingerprints": merkle.ORACLE_SQL,
        "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op6_line_dedup": lines.ORACLE_SQL,
        "op8_ngram_jaccard_join": near.ORACLE_SQL,
        "op13_merkle_manifest": manifest.ORACLE_SQL,
    }
