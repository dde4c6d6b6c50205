"""Keyed tables without a MERGE: every change is a join and a union, written beside the old table and swapped by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Incoming documents to process: all but those stored with the same sha1 and not up for review."""
    if force:
        return incoming
    done = stored.where("coalesce(needs_review, 0) = 0 and sha1 is not null").select("doc_id", "sha1")
    return incoming.join(done, ["doc_id", "sha1"], "left_anti").select(*incoming.columns)


def indexable(index: DataFrame, files: DataFrame) -> DataFrame:
    """Records that were downloaded and whose file is there. files: local_path."""
    return index.where("download_ok and coalesce(local_path, '') <> ''").join(files.select("local_path").distinct(), "local_path", "left_semi").select(*index.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, carried: Sequence[str] = ()) -> DataFrame:
    """Incoming rows over stored ones by key; columns in carried keep the stored value."""
    if carried:
        old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in carried])
        incoming = incoming.drop(*carried).join(old, key, "left").withColumnsRenamed({f"old_{c}": c for c in carried})
    kept = stored.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.select(*[c for c in stored.columns])).select(*stored.columns)


def replace_for(stored: DataFrame, incoming: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """All stored rows of ids replaced by the incoming rows; ids without incoming rows lose theirs."""
    return stored.join(ids.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def update_metadata(vectors: DataFrame, updates: DataFrame, key: str = "chunk_id", column: str = "metadata") -> DataFrame:
    """Map entries of updates(key, updates map) over those of known keys; unknown keys are ignored."""
    merged = F.when(F.col("updates").isNull(), F.col(column)).otherwise(F.map_concat(F.map_filter(column, lambda k, v: ~F.map_contains_key("updates", k)), F.col("updates")))
    return vectors.join(updates, key, "left").withColumn(column, merged).select(*vectors.columns)


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """chunk_id and the flat metadata columns without nulls."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return chunks.select("chunk_id", *[text(c) for c in ("doc_id", "title", "section_path", "date", "source_url", "local_path", "clause_ref", "circular_number")], *[number(c) for c in ("chunk_index", "page_start", "page_end")])


def vector_count(vectors: DataFrame) -> DataFrame:
    """One row, vectors: the number of stored chunk_ids."""
    return vectors.agg(F.count_distinct("chunk_id").alias("vectors"))


def flagged_for_retry(documents: DataFrame, limit: int = 0) -> DataFrame:
    """PDF documents up for review by doc_id; a limit of 0 is none."""
    found = documents.where("needs_review = 1 and doc_type = 'pdf'").orderBy("doc_id")
    return found.limit(limit) if limit else found


def first_seen(records: DataFrame, seen: DataFrame, order: str = "discovery_ord") -> DataFrame:
    """New records by source_url, the first discovered of each; seen: source_url, download_ok (failed ones are tried again)."""
    done = seen.where("download_ok").select("source_url")
    new = records.join(done, "source_url", "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("source_url").orderBy(order))).where("n = 1").select(*records.columns)


def due(now: Column, last_success: Column, interval: float = 86_400) -> Column:
    return last_success.isNull() | (now - last_success >= interval)
