"""Second look at flagged PDF documents with a page transcriber."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.extractors import PageTranscriber, transcribe
from .extract import described, is_outlier
from .store import flagged_for_retry

# fixed value: pages of a document that are transcribed at most
MOST_PAGES = 30


def retry(documents: DataFrame, files: DataFrame, transcriber: PageTranscriber, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Flagged documents extracted anew from files (doc_id, content), and one row retried, improved, still_flagged."""
    chosen = flagged_for_retry(documents, limit)
    pages = transcribe(files.join(chosen.select("doc_id"), "doc_id", "left_semi"), transcriber, MOST_PAGES)
    new = described(chosen.drop("page_count", "word_count", "document_number").join(pages, "doc_id")).withColumns({"ocr_used": F.lit(1), "ocr_confidence": F.lit(None).cast("double"), "extraction_error": F.lit(None).cast("string")})
    new = new.withColumn("needs_review", is_outlier().cast("int"))
    stats = new.agg(F.count("*").alias("retried"), F.count_if(F.col("needs_review") == 0).alias("improved"), F.count_if(F.col("needs_review") == 1).alias("still_flagged"))
    return new, stats
