"""Schemas of the store's tables, and reading of tables written with an older one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}


def columns(text: str) -> T.StructType:
    """A schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


DOC_INDEX = columns("doc_id string, section_path string, title string, date_raw string, date_parsed string, source_url string, local_path string, sha1 string, doc_type string, menu_id string, discovered_at string, download_ok boolean, http_status int, error string")
DOCUMENTS = columns("doc_id string, title string, section_path string, date_raw string, date_parsed string, source_url string, local_path string, sha1 string, doc_type string, has_text_layer int, ocr_used int, ocr_confidence double, word_count int, page_count int, extraction_error string, needs_review int, indexed_at string, document_number string, superseded_by_doc_id string, superseded_by_summary string")
CHUNKS = columns("chunk_id string, doc_id string, chunk_index int, text string, title string, section_path string, date string, source_url string, local_path string, doc_type string, clause_ref string, page_start int, page_end int, circular_number string, superseded_by_doc_id string, superseded_by_summary string, status string, status_note string")
REFS = columns("doc_id string, ref_ord int, relation string, referenced_label string, referenced_number string, referenced_year string, referenced_date_raw string, referenced_clause string, matched_sentence string")
VECTORS = columns("chunk_id string, embedding array<float>")
CASES = columns("question string, expected_number string, expected_keyword string, exhaustive boolean, notes string")
#: What the store keeps beside the three tables: numbers of documents, references with their source's date and name, statuses and roll-ups of targets, the keyword index.
NUMBERS = columns("doc_id string, number_key string, date_parsed string, key_bucket int")
LINKS = columns("doc_id string, ref_ord int, relation string, number_key string, referenced_clause string, source_date string, source_summary string, key_bucket int")
STATUSES = columns("doc_id string, chunk_id string, status string, status_note string, winner string")
ROLLUPS = columns("doc_id string, superseded_by_doc_id string, superseded_by_summary string")
POSTINGS = columns("doc_id string, chunk_id string, term string, positions array<int>, length int, bucket int, block int")
BLOCKS = columns("term string, block int, n int, most int, shortest int, bucket int")
LENGTHS = columns("doc_id string, n_chunks int, n_tokens int")
UPDATE_STATE = columns("status string, detail string, last_success_at double, last_attempt_at double")
DEFAULTS = {"status": "current", "needs_review": 0}


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the columns of schema: missing ones get their default, present ones their type.

    A chunk table from before per-chunk status takes it over from the
    whole-document flag: a chunk of a superseded document is superseded.
    """
    have = set(df.columns)
    columns = []
    for field in schema:
        if field.name in have:
            value = F.col(field.name)
        elif field.name == "status" and "superseded_by_doc_id" in have:
            value = F.when(F.coalesce("superseded_by_doc_id", F.lit("")) != "", "superseded").otherwise("current")
        elif field.name == "status_note" and "superseded_by_summary" in have:
            value = F.col("superseded_by_summary")
        else:
            value = F.lit(DEFAULTS.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(columns)
