"""The document index as files, evaluation cases, and the update state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CASES, DOC_INDEX, UPDATE_STATE


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON array of records (an indented one is read in splits), or a folder of JSON lines as ``write_index`` leaves it; empty if there is none."""
    return _read(spark, path, DOC_INDEX)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CASES)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row; the default if there is no file or it can't be read."""
    default = spark.createDataFrame([("idle", "", None, None)], UPDATE_STATE)
    state = _read(spark, path, UPDATE_STATE).where("status is not null")
    return default if state.isEmpty() else state


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = names.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(names):
        return spark.createDataFrame([], schema)
    if not files.getFileStatus(names).isFile():
        return spark.read.schema(schema).json(path)
    head = spark.read.option("lineSep", "{").text(path).limit(1).collect()
    indent = re.fullmatch(r"\[(\n +)", head[0][0]) if head else None
    return read_split(spark, path, schema, indent[1]) if indent else spark.read.schema(schema).option("multiLine", True).json(path)


def read_split(spark: SparkSession, path: str, schema, indent: str = "\n  ") -> DataFrame:
    """An indented JSON array of objects, read by as many tasks as the file has splits.

    The end of an element and the begin of the next, each on a line with the
    array's indent, separate the elements: a line break stands in no JSON
    string, and what is nested in an element is indented more.
    """
    parts = spark.read.option("lineSep", f"{indent}}},{indent}{{").text(path)
    inner = F.regexp_replace(F.regexp_replace("value", r"^\[\s*\{", ""), r"\}\s*\]\s*$", "")
    return parts.select(F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), schema).alias("r")).select("r.*")


def write_index(index: DataFrame, folder: str) -> None:
    """Parquet as the native form, JSON lines and CSV in the schema's column order beside it."""
    ordered = index.select(*[F.col(f.name).cast(f.dataType) for f in DOC_INDEX])
    ordered.write.mode("overwrite").parquet(f"{folder}/index.parquet")
    ordered.write.mode("overwrite").json(f"{folder}/index.json")
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/index.csv")


def write_state(spark: SparkSession, path: str, status: str, detail: str = "", last_success_at: float | None = None, last_attempt_at: float | None = None) -> None:
    spark.createDataFrame([(status, detail, last_success_at, last_attempt_at)], UPDATE_STATE).coalesce(1).write.mode("overwrite").json(path)
