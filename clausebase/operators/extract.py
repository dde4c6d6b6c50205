"""From page texts to the store's rows: quality flags, own number and date, chunks and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import document_ref, references
from ..functions.text import word_count
from .chunking import chunk_documents

# fixed values: thresholds
LEAST_WORDS_PER_PAGE, LEAST_CONFIDENCE, OCR_BELOW = 30.0, 50.0, 20.0


def is_outlier(least: float = LEAST_WORDS_PER_PAGE) -> Column:
    """Of word_count, page_count, ocr_used, ocr_confidence, extraction_error."""
    sparse = (F.coalesce("page_count", F.lit(0)) <= 0) | (F.try_divide("word_count", "page_count") < least)
    unsure = F.coalesce(F.col("ocr_used").cast("boolean"), F.lit(False)) & F.coalesce(F.col("ocr_confidence") < LEAST_CONFIDENCE, F.lit(False))
    return (F.coalesce("extraction_error", F.lit("")) != "") | F.coalesce(sparse, F.lit(True)) | unsure


def office_needs_review() -> Column:
    """Of extraction_error, best_effort, word_count."""
    return (F.coalesce("extraction_error", F.lit("")) != "") | F.coalesce("best_effort", F.lit(False)) | (F.col("word_count") == 0)


def needs_ocr() -> Column:
    return F.coalesce(F.try_divide("word_count", "page_count"), F.lit(0.0)) < OCR_BELOW


def better_pages(native: str = "pages", ocr: str = "ocr_pages") -> Column:
    """OCR pages only where they hold strictly more words."""
    words = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + word_count(p))
    return F.when(words(ocr) > words(native), F.col(ocr)).otherwise(F.col(native))


def mean_confidence(pages: DataFrame) -> DataFrame:
    """doc_id, ocr_confidence: mean of confidences of 0 or more, 0.0 if there is none."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("ocr_confidence"))


def whole_text() -> Column:
    return F.array_join("pages", "\n\n")


def described(docs: DataFrame) -> DataFrame:
    """docs (index columns, pages) with text, word_count, page_count, number and dates: own ones where detected, else the index's."""
    own = docs.withColumn("text", whole_text()).withColumn("own", document_ref(F.col("text")))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return own.withColumns({"word_count": word_count(F.col("text")), "page_count": F.size("pages"), "document_number": F.col("own.number"), "date_raw": either("own.date_raw", "date_raw"), "date_parsed": either("own.date_parsed", "date_parsed")}).drop("own")


def placeholder(date: Column) -> Column:
    full = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.concat(F.lit("No text could be extracted from this document. Title: "), full(F.col("title"), "unknown"), F.lit(". Section: "), full(F.col("section_path"), "unknown"), F.lit(". Date: "), full(date, "unknown"), F.lit(". File: "), full(F.col("local_path"), "unknown"), F.lit("."))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Chunk-table rows of described documents; blank ones get one placeholder chunk."""
    date = F.coalesce(F.nullif(F.col("date_parsed"), F.lit("")), F.col("date_raw"))
    blank = ~F.col("text").rlike(r"(?U)\S")
    own = docs.select("doc_id", "title", "section_path", date.alias("date"), "source_url", "local_path", "doc_type", F.col("document_number").alias("circular_number"), F.when(blank, F.array(placeholder(date))).otherwise(F.col("pages")).alias("pages"))
    out = chunk_documents(own)
    return out.withColumns({"superseded_by_doc_id": F.lit(None).cast("string"), "superseded_by_summary": F.lit(None).cast("string"), "status": F.lit("current"), "status_note": F.lit(None).cast("string")})


def ref_rows(docs: DataFrame) -> DataFrame:
    """Reference rows of described documents, ref_ord by relation and place within each."""
    each = docs.select("doc_id", F.posexplode(references(F.col("text"))).alias("ref_ord", "r"))
    return each.select("doc_id", "ref_ord", *[f"r.{c}" for c in ("relation", "referenced_label", "referenced_number", "referenced_year", "referenced_date_raw", "referenced_clause", "matched_sentence")])


def backfill(documents: DataFrame, chunks: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers and dates detected anew from each document's first chunk: documents, chunks, and one row checked, updated.

    A number already stored stays if only a date is detected, unless overwrite.
    """
    first = chunks.groupBy("doc_id").agg(F.min_by("text", "chunk_index").alias("first_text"))
    found = first.select("doc_id", document_ref(F.col("first_text")).alias("r")).select("doc_id", F.col("r.number").alias("new_number"), F.col("r.date_raw").alias("new_raw"), F.col("r.date_parsed").alias("new_parsed"))
    hit = found.where("new_number is not null or new_parsed is not null")
    keep = lambda new, old: F.when(F.col("hit"), F.col(new) if overwrite else F.coalesce(new, old)).otherwise(F.col(old))
    marked = hit.withColumn("hit", F.lit(True))
    docs = documents.join(marked, "doc_id", "left").withColumns({"document_number": keep("new_number", "document_number"), "date_raw": F.coalesce("new_raw", "date_raw"), "date_parsed": F.coalesce("new_parsed", "date_parsed")}).select(*documents.columns)
    parts = chunks.join(marked, "doc_id", "left").withColumns({"circular_number": keep("new_number", "circular_number"), "date": F.coalesce("new_parsed", "date")}).select(*chunks.columns)
    stats = found.agg(F.count("*").alias("checked"), F.count_if(F.col("new_number").isNotNull() | F.col("new_parsed").isNotNull()).alias("updated"))
    return docs, parts, stats
