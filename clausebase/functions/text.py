"""Splitting, counting and formatting of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: patterns, sizes, labels and templates
CLAUSE_START = r"(?U)^\s*(?:(?:Para(?:graph)?|Clause|Cl)\.?\s*)?(\d+(?:\.\d+)*\.?|\([a-zA-Z0-9ivxIVX]{1,5}\)|[A-Z]\.)\s+"
SENTENCE_BREAK = r"(?U)(?<=[.;:])\s+(?=[A-Z0-9(])"
BLANK_LINE = r"(?U)\n\s*\n"
FORBIDDEN = r'[<>:"/\\|?*]'
EXHAUSTIVE = r"(?i)\blist\s+all\b|\bevery\s+circular\b|\ball\s+circulars?\b|\bsummarize\s+all\b|\ball\s+rules?\s+on\b|\ball\s+of\s+the\b|\bcomplete\s+list\b"
STATUS_LABELS = {"superseded": "SUPERSEDED by", "amended": "AMENDED by", "ambiguous": "AMBIGUOUS --"}
NO_EXCERPTS = "No retrieved excerpts were found in the knowledge base for this question."


def fence(value: Column) -> Column:
    """Computed where it stands: filters, lambdas and generators above otherwise get a copy of the whole expression."""
    return F.when(F.spark_partition_id() >= 0, value)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clause_ref(paragraph: Column) -> Column:
    """The number a paragraph starts with, null if none."""
    return F.nullif(F.rtrim(F.regexp_extract(paragraph, CLAUSE_START, 1), F.lit(".")), F.lit(""))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def paragraphs(text: Column, most_words: int = 1000) -> Column:
    """Blocks between blank lines, stripped, none empty; a block over most_words words is cut into its sentences."""
    blocks = F.filter(F.transform(F.split(text, BLANK_LINE), strip), lambda b: b != "")
    cut = F.transform(blocks, lambda b: F.when(word_count(b) <= most_words, F.array(b)).otherwise(F.filter(F.transform(sentences(b), strip), lambda s: s != "")))
    return F.flatten(cut)


def is_exhaustive(question: Column) -> Column:
    return question.rlike(EXHAUSTIVE)


def conversational_query(question: Column, previous: Column) -> Column:
    return F.concat_ws("\n", F.nullif(previous, F.lit("")), question)


def with_previous_question(turns: DataFrame) -> DataFrame:
    """User turns of (conv_id, turn, role, text) with previous and the combined query."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = turns.where("role = 'user'").withColumn("previous", F.lag("text").over(order))
    return users.withColumn("query", conversational_query(F.col("text"), F.col("previous")))


def recent_questions(turns: DataFrame, most: int = 8) -> DataFrame:
    """The last ``most`` user turns of each conversation, newest first (rank from 1)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.where("role = 'user'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def page_label(start: Column, end: Column) -> Column:
    some = F.coalesce(start, F.lit(0)) != 0
    span = (F.coalesce(end, F.lit(0)) != 0) & (end != start)
    return F.when(~some, "unknown").when(span, F.concat(start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(start.cast("string"))


def status_line(status: Column, note: Column) -> Column:
    """With its line break; empty for current chunks and where there is no note."""
    label = F.upper(status)
    for name, text in STATUS_LABELS.items():
        label = F.when(status == name, text).otherwise(label)
    none = (status == "current") | (F.coalesce(note, F.lit("")) == "")
    return F.when(none, "").otherwise(F.concat(F.lit("Status: "), label, F.lit(" "), note, F.lit("\n")))


def excerpt(number: Column) -> Column:
    """One excerpt block from the columns of a retrieval hit."""
    full = lambda name, other: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(other))
    return F.concat(
        F.lit("[Excerpt "), number.cast("string"), F.lit("]\nTitle: "), F.col("title"), F.lit("\nDate: "), full("date", "unknown"), F.lit("\nNotification/Letter No.: "), full("circular_number", "not detected"),
        F.lit("\nSection: "), F.col("section_path"), F.lit("\nClause: "), full("clause_ref", "none detected"), F.lit("\nPage: "), page_label(F.col("page_start"), F.col("page_end")), F.lit("\n"),
        status_line(F.col("status"), F.col("status_note")), F.lit("Source URL: "), F.col("source_url"), F.lit("\n---\n"), F.col("text"), F.lit("\n"),
    )


def user_message(question: str, hits: DataFrame, rank: str = "rank") -> DataFrame:
    """One row, message: the excerpts in order of rank, and the question."""
    blocks = hits.select(F.col(rank).alias("r"), excerpt(F.col(rank)).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]), "\n\n").alias("context"))
    some = F.concat(F.lit("Retrieved excerpts:\n\n"), F.col("context"), F.lit(f"\n\nQuestion: {question}"))
    return blocks.select(F.when(F.col("context") == "", F.lit(f"Question: {question}\n\n{NO_EXCERPTS}")).otherwise(some).alias("message"))


def safe_path(section_path: Column) -> Column:
    parts = F.filter(F.transform(F.split(section_path, ">"), strip), lambda p: p != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda p: F.substring(F.regexp_replace(p, FORBIDDEN, "_"), 1, 80)), "/"), F.lit("")), F.lit("misc"))


def safe_filename(title: Column, doc_id: Column, doc_type: Column) -> Column:
    name = F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(title, FORBIDDEN, "_")), 1, 100), F.lit("")), F.lit("document"))
    return F.concat(name, F.lit("_"), F.substring(doc_id, 1, 8), F.lit("."), doc_type)


def breadcrumb(parent: Column, label: Column, menu_id: Column) -> Column:
    own = F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("section-"), menu_id))
    return F.btrim(F.concat(parent, F.lit(" > "), own), F.lit(" >"))
