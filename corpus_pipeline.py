"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``; what a stage
drops is gone for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clausebase.llm import decontaminate, language, lines, mixing, near
from clausebase.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the mixture model finds with a share of at least one half; the model learns from these documents."""
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or resemble an earlier one; those left with nothing go."""
    return lines.keep_first_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the lowest doc_id."""
    return near.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens taken of each document under the hierarchical budget."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
]

#: Stages learn a language model and draw hashed paths, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go to the shared folder of ``spark.checkpoint.dir``."""
    docs = table(spark, sf_dir, "documents")
    shared = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
