"""Registered queries over stores that ingestion makes of the driver's tables, each with its SQL for DuckDB.

Each call writes its store to a folder of its own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import keyword, retrieval, scrape
from .plans.corpora import CHUNKS, CIRCULARS, REFS, derived
from .registry import _PACKED, _RESOLVE, _SITE, _TOKENS, KEYWORDS, ORACLES, _site, _table, oracle_sql, queries, query
from .schemas import POSTINGS, STATUSES
from .sources.snapshots import shared_folder
from .streaming import gate, ingest

__all__ = ["oracle_sql", "queries"]


def _store(spark: SparkSession) -> ingest.Store:
    return ingest.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of one page; its lines are paragraphs."""
    none = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("Paper "), "doc_id").alias("title"), F.col("source").alias("section_path"), none.alias("date_raw"), none.alias("date_parsed"), none.alias("source_url"), none.alias("local_path"),
        F.sha1(F.col("text").cast("binary")).alias("sha1"), F.lit("pdf").alias("doc_type"), F.array(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("pages"), F.lit(1).alias("has_text_layer"), F.lit(0).alias("ocr_used"), F.lit(None).cast("double").alias("ocr_confidence"), none.alias("extraction_error"),
    )


@query(
    _PACKED
    + r"""SELECT 'd' || d.doc_id AS doc_id, sha1(d.text) AS sha1, len(regexp_extract_all(d.text, '\S+')) AS word_count, (len(regexp_extract_all(d.text, '\S+')) < 30)::INT AS needs_review, coalesce(c.n, 1) AS n_chunks, coalesce(c.w, 8 + len(regexp_extract_all(coalesce(d.source, ''), '\S+'))) AS chunk_words, 2 AS version
FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT chunk) AS n, sum(words)::BIGINT AS w FROM st GROUP BY doc_id) c ON c.doc_id = d.doc_id"""
)
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and chunks of the second of two commits; the first held an older text of every document."""
    to, new = _store(spark), _incoming(spark, sf_dir)
    ingest.ingest_batch(to, new.withColumns({"sha1": F.lit("old"), "pages": F.array(F.col("title"))}))
    state = ingest.ingest_batch(to, new)
    to.clean(keep=1, grace=0)
    words = F.regexp_count("text", F.lit(r"(?U)\S+"))
    per = ingest.chunks_of(state).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(words).alias("chunk_words"))
    return ingest.documents_of(state).join(per, "doc_id").select("doc_id", "sha1", F.col("word_count").cast("long").alias("word_count"), "needs_review", "n_chunks", "chunk_words", F.lit(state.version).alias("version"))


def _indexed(spark: SparkSession, sf_dir: str) -> ingest.Snapshot:
    """An index of all documents; an older one, of their sources, was replaced."""
    to = _store(spark)
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", "source", F.lit("").alias("title"))
    for text in ("source", "text"):
        change = to.begin()
        ingest.replace_index(change, chunks.withColumn("text", F.col(text)), chunks.select("doc_id"))
        change.commit()
    return to.snapshot()


@query(ORACLES["keyword_search"])
def stored_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword.search(ingest.index_of(_indexed(spark, sf_dir), KEYWORDS), KEYWORDS, 10_000_000)
    order = found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "bm25").orderBy(F.round("bm25", 9), "chunk_id")
    return order.limit(retrieval.SPECIFIC_TOP).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(ORACLES["keyword_search"])
def pruned_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits from those blocks only whose bound allows them."""
    state = _indexed(spark, sf_dir)
    ingest.optimise_index(state.store)
    found = ingest.keyword_hits(state.store.snapshot(), KEYWORDS, 20)
    order = found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "bm25").orderBy(F.round("bm25", 9), "chunk_id")
    return order.limit(retrieval.SPECIFIC_TOP).select("chunk_id", F.round("bm25", 6).alias("bm25"))


_ASKED = f"""q AS (SELECT item_id, w[2:3] AS ws FROM (SELECT item_id, {_TOKENS.format("text")} AS w FROM benchmark) WHERE len(w) >= 3),
t AS (SELECT doc_id, {_TOKENS.format("text")} AS ws FROM documents), z AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
f AS (SELECT doc_id, d, term, count(*) AS f FROM (SELECT doc_id, len(ws) AS d, unnest(ws) AS term FROM t) GROUP BY ALL),
i AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS i FROM f, z GROUP BY term, n),
u AS (SELECT item_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM q),
s AS (SELECT item_id, doc_id, -sum(i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS b FROM u JOIN f USING (term) JOIN i USING (term), z GROUP BY item_id, doc_id HAVING count(*) = 2),
r AS (SELECT item_id, doc_id, b, row_number() OVER (PARTITION BY item_id ORDER BY round(b, 9), doc_id::VARCHAR) AS rank FROM s)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third word of every benchmark item."""
    words = keyword.tokens(F.col("text"))
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), words.alias("w")).where(F.size("w") >= 3).select("question_id", F.array_join(F.slice("w", 2, 2), " ").alias("question"))


@query(f"WITH {_ASKED} SELECT item_id AS question_id, doc_id AS chunk_id, round(b, 6) AS bm25, rank FROM r WHERE rank <= 6")
def keyword_hits_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a question for every benchmark item, all in one plan over the stored index."""
    found = keyword.search_many(ingest.whole_index_of(_indexed(spark, sf_dir)), _questions(spark, sf_dir), retrieval.SPECIFIC_TOP)
    return found.select("question_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(
    f"""WITH {_ASKED}, c AS (SELECT item_id, ws[1] || ' ' || ws[2] AS question, ws[2] AS expected FROM q)
SELECT question, bool_or(hit) AS passed FROM (SELECT question, expected, count(r.doc_id) > 0 AND coalesce(bool_or(contains(lower(d.source), expected) OR expected = ''), false) AS hit FROM c LEFT JOIN r ON r.item_id = c.item_id AND rank <= 6 LEFT JOIN documents d ON d.doc_id = r.doc_id GROUP BY c.item_id, question, expected) GROUP BY question"""
)
def validated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for every benchmark item: whether a source named by the question's second word is cited."""
    state = _indexed(spark, sf_dir)
    none = F.lit(None).cast("string")
    chunks = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("title"), F.col("source").alias("section_path"), *[none.alias(c) for c in ("date", "source_url", "local_path", "clause_ref", "circular_number", "status", "status_note")], F.lit(0).alias("page_start"), F.lit(0).alias("page_end")
    )
    cases = _questions(spark, sf_dir).select("question", none.alias("expected_number"), F.substring_index("question", " ", -1).alias("expected_keyword"), F.lit(False).alias("exhaustive"))
    judged = retrieval.validate(cases, chunks, ingest.whole_index_of(state))
    return judged.groupBy("question").agg(F.max("passed").alias("passed"))


@query(
    """WITH q AS (SELECT vec_id AS question_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT question_id, vec_id, list_sum(list_transform(list_zip(embedding, v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings, q)
SELECT question_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 9), vec_id) AS rank FROM d) WHERE rank <= 6"""
)
def vector_hits_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every query vector (each id that 100 divides), among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.nearest_many(vectors, asked, retrieval.SPECIFIC_TOP, "vec_id").select("question_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def _in_cells(spark: SparkSession, sf_dir: str, cells: int) -> tuple[ingest.Snapshot, list[tuple]]:
    """All vectors in cells, and the stated queries: each id that 100 divides."""
    rows = _table(spark, sf_dir, "embeddings")
    own = rows.select((F.col("vec_id") % 97).cast("string").alias("doc_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.where("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()
    return ingest.index_vectors(_store(spark), own, cells), [(r["vec_id"], list(r["embedding"])) for r in asked]


@query(ORACLES["vector_hits_many"])
def cell_hits_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by the cells, all of them probed: exact."""
    state, asked = _in_cells(spark, sf_dir, 16)
    return ingest.vector_hits(state, asked, retrieval.SPECIFIC_TOP, 16).select("question_id", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("SELECT vec_id AS question_id, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean share of the six nearest that a search of 40 of 64 cells finds, over all stated queries, reaches 0.9."""
    state, asked = _in_cells(spark, sf_dir, 64)
    some = ingest.vector_hits(state, asked, retrieval.SPECIFIC_TOP, 40).select("question_id", "chunk_id", F.lit(1.0).alias("found"))
    vectors = _table(spark, sf_dir, "embeddings")
    exact = retrieval.nearest_many(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), retrieval.SPECIFIC_TOP, "vec_id").withColumnRenamed("vec_id", "chunk_id")
    each = exact.join(some, ["question_id", "chunk_id"], "left").groupBy("question_id").agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("recall"))
    return each.withColumn("mean", F.avg("recall").over(Window.partitionBy(F.lit(1)))).select("question_id", (F.col("mean") >= 0.9).alias("reached"))  # the stated queries only


_FRESH = _RESOLVE.replace("CASE WHEN l_orderkey % 50 = 0 THEN 'superseded' END AS status", "CAST(NULL AS STRING) AS status").replace("ORDER BY source_date DESC, ref_ord", "ORDER BY source_date DESC, source_id, ref_ord")


@query(_FRESH + "SELECT c.doc_id, f.chunk_id, f.status, f.note AS status_note, f.winner FROM fin f JOIN chunks c USING (chunk_id)")
def incremental_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after three commits, each with the circulars of some years, as they would arrive."""
    to = _store(spark)
    documents, chunks, refs = derived(spark, sf_dir, CIRCULARS, "orders"), derived(spark, sf_dir, CHUNKS, "lineitem"), derived(spark, sf_dir, REFS, "orders")
    year = F.substring("date_parsed", 1, 4).cast("int")
    for years in (year <= 1994, (year > 1994) & (year <= 1996), year > 1996):
        own = documents.where(years)
        ids = own.select("doc_id")
        change = to.begin()
        change.replace("chunks", chunks.join(ids, "doc_id", "left_semi").select("doc_id", "chunk_id", "clause_ref"), ids)
        ingest.replace_links(change, own, refs.join(ids, "doc_id", "left_semi").withColumn("ref_ord", F.col("ref_ord").cast("int")), ids)
        ingest.resolve_changed(change, ids)
        change.commit()
    return to.snapshot().read("statuses", STATUSES)


@query("SELECT term, count(*) AS n_docs, sum(f)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(" + _TOKENS.format("text") + ") AS term FROM documents) GROUP BY ALL) GROUP BY term")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and places of each term in the stored index, after the older one's postings are dead."""
    postings = _indexed(spark, sf_dir).read("postings", POSTINGS)
    return postings.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n"))


@query(f"SELECT doc_id, title, section_path, menu_id, doc_type, level, pages FROM ({ORACLES['crawled_documents']}), (SELECT 2 AS level), (SELECT 1 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS pages)")
def resumed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found by a crawl that ended after two pages and was taken up again, and how many pages it fetched in all."""
    to, site = _store(spark), _site(spark, sf_dir)
    answer = lambda asked: asked.join(site, "url").select("url", F.col("html").cast("binary").alias("content"), F.lit(200).alias("http_status"))
    scrape.crawl_store(to, _SITE + "0", answer, most_pages=2)
    state = scrape.crawl_store(to, _SITE + "0", answer)
    pages = scrape.menu_of(state).where("page_ok").agg(F.count("*").alias("pages"))
    return scrape.found_of(state, "/d").select("doc_id", "title", "section_path", "menu_id", "doc_type", "level").crossJoin(F.broadcast(pages))  # one row


@query("SELECT CAST(user_id AS VARCHAR) AS key, max_by(event_type, (ts, event_type)) AS version FROM events GROUP BY user_id")
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest kind of event, as the last version that a stream over the events let through."""
    events = _table(spark, sf_dir, "events")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events[.]parquet")  # a pattern: a stream can read a single file by it
    new = gate.new_versions(stream, "user_id", "event_type", "ts")
    new.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("key").agg(F.max_by("version", "at_micros").alias("version"))
