"""Coverage, statistics and the review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: at most so many documents in a section are few
LOW_COUNT = 2


def percent(part: Column, whole: Column) -> Column:
    """To one decimal, half to even; null for nothing."""
    return F.bround(100 * part.cast("double") / F.nullif(whole, F.lit(0)), 1)


def _numbered() -> Column:
    return F.coalesce("document_number", F.lit("")) != ""


def coverage_summary(index: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: discovered, downloaded, extracted, flagged, with_number, number_pct."""
    a = index.agg(F.count("*").alias("discovered"), F.count_if(F.col("download_ok")).alias("downloaded"))
    b = documents.agg(F.count("*").alias("extracted"), F.count_if(F.col("needs_review") == 1).alias("flagged"), F.count_if(_numbered()).alias("with_number"))
    key = F.lit(1).alias("k")
    return a.select("*", key).join(b.select("*", key), "k").drop("k").withColumn("number_pct", percent(F.col("with_number"), F.col("extracted")))


def coverage_sections(index: DataFrame, documents: DataFrame) -> DataFrame:
    """section_path, discovered, extracted, flag for every section of either side."""
    a = index.groupBy("section_path").agg(F.count("*").alias("discovered"))
    b = documents.groupBy("section_path").agg(F.count("*").alias("extracted"))
    both = a.join(b, "section_path", "full_outer")
    n = F.coalesce("discovered", F.lit(0))
    return both.select("section_path", n.alias("discovered"), F.coalesce("extracted", F.lit(0)).alias("extracted"), F.when(n <= LOW_COUNT, "LOW COUNT").otherwise("").alias("flag"))


def coverage_lines(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Markdown lines of the report: ord, line."""
    s = coverage_summary(index, documents)
    head = F.array(
        F.lit("# Coverage Report"), F.lit(""), F.lit("## Summary"), F.lit(""), F.concat(F.lit("- Documents discovered: **"), F.col("discovered"), F.lit("**")), F.concat(F.lit("- Documents downloaded: **"), F.col("downloaded"), F.lit("**")),
        F.concat(F.lit("- Documents extracted/indexed: **"), F.col("extracted"), F.lit("**")), F.concat(F.lit("- Documents flagged for manual review: **"), F.col("flagged"), F.lit("**")),
        F.when(F.col("extracted") > 0, F.concat(F.lit("- Documents with a detected notification/letter number: **"), F.col("with_number"), F.lit("** ("), F.col("number_pct"), F.lit("%)"))),
        F.lit(""), F.lit("## Per-section breakdown"), F.lit(""), F.lit("| Section | Discovered | Extracted | Flag |"), F.lit("| --- | ---: | ---: | --- |"),
    )
    top = s.select(F.posexplode(F.array_compact(head)).alias("ord", "line")).select(F.lit("").alias("section"), "ord", "line")
    rows = coverage_sections(index, documents).select(F.coalesce("section_path", F.lit("")).alias("section"), F.lit(1000).alias("ord"), F.concat(F.lit("| "), F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.lit("(root)")), F.lit(" | "), F.col("discovered"), F.lit(" | "), F.col("extracted"), F.lit(" | "), F.when(F.col("flag") != "", F.lit(" LOW COUNT")).otherwise(""), F.lit(" |")).alias("line"))
    return top.unionByName(rows).orderBy("ord", "section")


def store_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total, flagged, sections, chunks, coverage_pct, number_pct, superseded, amended."""
    d = documents.agg(F.count("*").alias("total"), F.count_if(F.col("needs_review") == 1).alias("flagged"), F.count_distinct("section_path").alias("sections"), F.count_if(_numbered()).alias("with_number"), F.count_if(F.coalesce("superseded_by_doc_id", F.lit("")) != "").alias("superseded"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "amended").alias("amended"))
    key = F.lit(1).alias("k")
    both = d.select("*", key).join(c.select("*", key), "k")
    pct = lambda p: F.coalesce(percent(p, F.col("total")), F.lit(0.0))
    return both.select("total", "flagged", "sections", "chunks", pct(F.col("total") - F.col("flagged")).alias("coverage_pct"), pct(F.col("with_number")).alias("number_pct"), "superseded", "amended")


def review_lines(documents: DataFrame) -> DataFrame:
    """Markdown list of documents up for review, one sentence if there is none."""
    rows = documents.where("needs_review = 1").select("doc_id", F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("** ("), F.coalesce("local_path", F.lit("")), F.lit("): "), F.coalesce(F.nullif(F.col("extraction_error"), F.lit("")), F.lit("low text quality"))).alias("line"))
    none = documents.agg(F.count_if(F.col("needs_review") == 1).alias("n")).where("n = 0").select(F.lit("").alias("doc_id"), F.lit("No documents need manual review.").alias("line"))
    return rows.unionByName(none).orderBy("doc_id")
