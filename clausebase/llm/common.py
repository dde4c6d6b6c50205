"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which it may be broadcast; every use counts first and has a shuffled way beyond it.
BROADCAST_ROWS = 20_000

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one on a local master, and an error on a cluster, whose machines don't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="clausebase-")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    _release(sc)  # those of earlier calls, whose plans their callers have let go by now
    out = df.checkpoint()
    _release(sc)
    return out


def _release(sc: SparkContext) -> None:
    """Plans that are no longer referred to free their shuffle files, now and not at the next half-hourly cleaning."""
    gc.collect()
    sc._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is known to be small, as it is otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def fence(value: Column) -> Column:
    """``value``, marked so that the optimiser computes it where it stands.

    Filters on a column built on it, and uses of it inside lambda functions,
    otherwise get a copy of its whole expression, evaluated for each element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def row_key() -> Column:
    """A key of rows equal in doc_id and text, null apart from any value."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
