"""References resolved into the legal status of every chunk.

References are classified by two left joins to the documents, turned into
proposals by one equi-join to the target's chunks (clauses as its residual
condition), and reconciled by one aggregation per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import FULL, INFORMATIONAL, PARTIAL, clause_matches, normal_clause, normal_number, summary

CONFLICT = "Conflicting supersession signals: "


@dataclass(frozen=True)
class Resolution:
    """statuses(chunk_id, status, note, winner), rollups(doc_id, superseded_by_doc_id, superseded_by_summary), counters (one row)."""

    statuses: DataFrame
    rollups: DataFrame
    counters: DataFrame


def classify(refs: DataFrame, documents: DataFrame, doc_order: str = "doc_id") -> DataFrame:
    """refs with target_id, source_date, source_summary and outcome (informational, unmatched, skipped_date_order, full, partial, unscoped).

    Of documents with the same normal number the last by doc_order counts.
    """
    numbered = documents.select(normal_number(F.col("document_number")).alias("number_key"), F.struct(F.col(doc_order).alias("o"), F.col("doc_id").alias("target_id"), F.col("date_parsed").alias("target_date")).alias("t"))
    targets = numbered.where("number_key is not null").groupBy("number_key").agg(F.max("t").alias("t")).select("number_key", "t.target_id", "t.target_date")
    sources = documents.select("doc_id", F.lit(True).alias("has_source"), F.coalesce("date_parsed", F.lit("")).alias("source_date"), summary(F.col("title"), F.col("document_number"), F.col("date_parsed")).alias("source_summary"))
    joined = refs.withColumn("number_key", normal_number(F.col("referenced_number"))).join(targets, "number_key", "left").join(sources, "doc_id", "left")
    return joined.withColumn("outcome", _outcome())


def _outcome() -> Column:
    return (
        F.when(F.col("relation").isin(*INFORMATIONAL), "informational")
        .when(F.col("target_id").isNull() | (F.col("target_id") == F.col("doc_id")) | F.col("has_source").isNull(), "unmatched")
        .when((F.col("source_date") != "") & (F.coalesce("target_date", F.lit("")) != "") & (F.col("source_date") < F.col("target_date")), "skipped_date_order")
        .when(F.col("relation").isin(*FULL), "full")
        .when(F.col("relation").isin(*PARTIAL) & (F.coalesce("referenced_clause", F.lit("")) != ""), "partial")
        .otherwise("unscoped")
    )


def _latest_first(date: str) -> Column:
    """A key that sorts ISO dates backwards, and no date last."""
    return F.coalesce(F.nullif(F.translate(date, "0123456789", "9876543210"), F.lit("")), F.lit("~"))


def resolve(documents: DataFrame, chunks: DataFrame, refs: DataFrame, doc_order: str = "doc_id") -> Resolution:
    """documents: doc_id, title, document_number, date_parsed; chunks: chunk_id, doc_id, clause_ref, status, status_note; refs: ref_ord (unique, any type that sorts), doc_id, relation, referenced_number, referenced_clause.

    A chunk without a new proposal keeps its status.  Of proposals of one
    status the latest date wins, then the first reference; different statuses
    make it ambiguous.  A document is rolled up if every chunk is newly or still
    superseded and exactly one document is known to have done it.
    """
    ref = classify(refs, documents, doc_order)
    judged = _judged(_pairs(ref, chunks))
    statuses = _statuses(judged).drop("doc_id")
    rollups = _rollups(judged)

    used = _pairs(ref, chunks).where("scoped and outcome = 'partial'").select("ref_ord").distinct().withColumn("matched", F.lit(True))
    counted = ref.join(used, "ref_ord", "left")
    unscoped = (F.col("outcome") == "unscoped") | ((F.col("outcome") == "partial") & F.col("matched").isNull())
    by_ref = counted.agg(F.count("*").alias("refs_checked"), F.count_if(F.col("outcome") == "unmatched").alias("unmatched"), F.count_if(F.col("outcome") == "skipped_date_order").alias("skipped_date_order"), F.count_if(unscoped).alias("skipped_unscoped_partial"), F.count_if(F.col("outcome") == "informational").alias("informational_skipped"))
    by_chunk = statuses.agg(*[F.count_if(F.col("status") == s).alias(f"chunks_{s}") for s in ("superseded", "amended", "ambiguous")])
    by_doc = rollups.agg(F.count("*").alias("documents_fully_superseded"))
    key = F.lit(1).alias("k")  # one row each
    counters = by_ref.select("*", key).join(by_chunk.select("*", key), "k").join(by_doc.select("*", key), "k").drop("k")
    return Resolution(statuses, rollups, counters)


def _pairs(ref: DataFrame, chunks: DataFrame) -> DataFrame:
    """Classified references and all chunks of their targets; scoped says whether one speaks of the other."""
    live = ref.where(F.col("outcome").isin("full", "partial")).select("ref_ord", "target_id", "outcome", "referenced_clause", "source_date", "source_summary", F.col("doc_id").alias("source_id"))
    own = chunks.select("chunk_id", F.col("doc_id").alias("target_id"), normal_clause(F.col("clause_ref")).alias("own_clause"), F.coalesce("status", F.lit("current")).alias("old"))
    scoped = (F.col("outcome") == "full") | clause_matches(F.col("own_clause"), normal_clause(F.col("referenced_clause")))
    return live.join(own, "target_id").withColumn("scoped", scoped)


def _judged(pairs: DataFrame) -> DataFrame:
    """doc_id, chunk_id, old, status, note, winner of every chunk of a target; the last three are null if no reference speaks of it.

    The pairs lie by document from the join on, and chunks and roll-ups are
    aggregated where they lie: each table is shuffled once.
    """
    status = F.when(F.col("outcome") == "full", "superseded").otherwise("amended")
    note = F.when(F.col("outcome") == "full", F.col("source_summary")).otherwise(F.concat(F.lit("Amended (Clause "), F.col("referenced_clause"), F.lit(") by "), F.col("source_summary")))
    said = lambda value: F.when(F.col("scoped"), value)
    proposals = pairs.select("target_id", "chunk_id", "old", "ref_ord", "source_date", "source_id", said(status).alias("status"), said(note).alias("note"))
    each = proposals.groupBy(F.col("target_id").alias("doc_id"), "chunk_id", "old").agg(
        F.min("status").alias("low"), F.max("status").alias("high"),
        F.min_by(F.struct("note", "source_id"), F.when(F.col("status").isNotNull(), F.struct(_latest_first("source_date"), "ref_ord"))).alias("best"),
        F.collect_set("note").alias("notes"),
    )
    one = F.col("low") == F.col("high")
    conflict = F.concat(F.lit(CONFLICT), F.array_join(F.array_sort("notes"), "; "))
    return each.select("doc_id", "chunk_id", "old", F.when(one, F.col("low")).when(F.col("low") != F.col("high"), "ambiguous").alias("status"), F.when(one, F.col("best.note")).when(F.col("low") != F.col("high"), conflict).alias("note"), F.when(one, F.col("best.source_id")).alias("winner"))


def _statuses(judged: DataFrame) -> DataFrame:
    """doc_id, chunk_id, status, note, winner."""
    return judged.where("status is not null").select("doc_id", "chunk_id", "status", "note", "winner")


def _rollups(judged: DataFrame) -> DataFrame:
    """A document without a reference has no winner, so targets are enough."""
    gone = F.coalesce("status", "old") == "superseded"
    rolled = judged.groupBy("doc_id").agg(F.bool_and(gone).alias("all_gone"), F.min("winner").alias("low"), F.max("winner").alias("superseded_by_doc_id"), F.max_by("note", F.when(F.col("winner").isNotNull(), F.col("chunk_id"))).alias("superseded_by_summary"))
    return rolled.where("all_gone and low = superseded_by_doc_id").select("doc_id", "superseded_by_doc_id", "superseded_by_summary")


def linked(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """refs (doc_id, ref_ord, relation, referenced_number, referenced_clause) with the key they look up and their source's date and name, which change only with the source."""
    sources = documents.select("doc_id", F.coalesce("date_parsed", F.lit("")).alias("source_date"), summary(F.col("title"), F.col("document_number"), F.col("date_parsed")).alias("source_summary"))
    own = refs.select("doc_id", "ref_ord", "relation", normal_number(F.col("referenced_number")).alias("number_key"), "referenced_clause")
    return own.join(sources, "doc_id").where("number_key is not null")


def resolve_keys(numbers: DataFrame, links: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses (doc_id, chunk_id, status, note, winner) and roll-ups of the documents of some numbers, from nothing but these.

    numbers (doc_id, number_key, date_parsed), links (as of ``linked``) and
    chunks (doc_id, chunk_id, clause_ref) hold all rows of those keys and of
    their documents.  What a chunk's status was before doesn't count.
    """
    targets = numbers.groupBy("number_key").agg(F.max(F.struct(F.col("doc_id").alias("target_id"), F.col("date_parsed").alias("target_date"))).alias("t")).select("number_key", "t.*")
    ref = links.join(targets, "number_key").withColumns({"has_source": F.lit(True), "ref_ord": F.struct("doc_id", "ref_ord")})
    judged = _judged(_pairs(ref.withColumn("outcome", _outcome()), chunks.withColumn("status", F.lit(None).cast("string"))))
    return _statuses(judged), _rollups(judged)


def apply_statuses(chunks: DataFrame, found: Resolution) -> DataFrame:
    """The chunk table with new statuses and the whole-document columns of its documents."""
    new = found.statuses.select("chunk_id", F.col("status").alias("new_status"), F.col("note").alias("new_note"))
    rolled = found.rollups.select("doc_id", F.col("superseded_by_doc_id").alias("new_by"), F.col("superseded_by_summary").alias("new_summary"))
    joined = chunks.join(new, "chunk_id", "left").join(rolled, "doc_id", "left")
    changed = {"status": F.coalesce("new_status", "status", F.lit("current")), "status_note": F.coalesce("new_note", "status_note"), "superseded_by_doc_id": F.coalesce("new_by", "superseded_by_doc_id"), "superseded_by_summary": F.coalesce("new_summary", "superseded_by_summary")}
    return joined.withColumns(changed).select(*chunks.columns)


def apply_rollups(documents: DataFrame, found: Resolution) -> DataFrame:
    new = found.rollups.select("doc_id", F.col("superseded_by_doc_id").alias("new_by"), F.col("superseded_by_summary").alias("new_summary"))
    joined = documents.join(new, "doc_id", "left")
    return joined.withColumns({"superseded_by_doc_id": F.coalesce("new_by", "superseded_by_doc_id"), "superseded_by_summary": F.coalesce("new_summary", "superseded_by_summary")}).select(*documents.columns)
