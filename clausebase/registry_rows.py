"""Registered queries of the row-wise operators, the store's tables, the reports and whole retrieval, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text, urls
from .operators import chunking, crawl, extract, keyword, report, resolve, retrieval, store
from .plans.corpora import CHUNKS, LETTERS, derived
from .registry import _DISTANCE, _RESOLVE, _TOKENS, KEYWORDS, ORACLES, _corpus, _index, _query_vector, _table, oracle_sql, queries, query

__all__ = ["oracle_sql", "queries"]  # of both modules


def _text(value: str) -> Column:
    return F.expr(value).cast("string")


@query("""SELECT o_orderkey, try_cast((CASE WHEN o_orderkey % 100 <= 69 THEN 2000 ELSE 1900 END + o_orderkey % 100) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE)::VARCHAR AS iso FROM orders""")
def two_digit_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("of "), _text("o_orderkey % 33"), F.lit("/"), _text("o_orderkey % 14"), F.lit("/"), F.lpad(_text("o_orderkey % 100"), 2, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw).alias("iso"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderkey % 2 = 0 THEN '3rd March 2020' WHEN o_orderkey % 5 = 0 THEN '12-06-19' END AS date_raw FROM orders""")
def nearby_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("issued "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" and 1.1.2001")))
    element = F.when(F.expr("o_orderkey % 2 = 0"), "as of 3rd March 2020, signed").otherwise("no date at all")
    anchor = F.when(F.expr("o_orderkey % 5 = 0"), "Letter 12-06-19").otherwise("Letter")
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.nearby_date(row, element, anchor).alias("date_raw"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '4.2' WHEN 1 THEN '(iv)' WHEN 2 THEN 'A' WHEN 3 THEN '12' WHEN 4 THEN '(b)' END AS clause FROM orders""")
def clause_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraph = F.get(F.array(*[F.lit(x) for x in ("  Para 4.2. Fees", "(iv) the rest", "A. Scope", "12 wagons", "Clause (b) holds", "Fees of 4.2 per cent", "4.2")]), F.expr("cast(o_orderkey % 7 as int)"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.clause_ref(paragraph).alias("clause"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://Old.example/a' WHEN 1 THEN 'https://old.example/b' ELSE 'http://new.example/c' END AS url FROM orders""")
def https_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.get(F.array(F.lit("http://Old.example/a"), F.lit("https://old.example/b"), F.lit("http://new.example/c")), F.expr("cast(o_orderkey % 3 as int)"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", urls.normal_scheme(url, ["old.example"]).alias("url"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows made of ``documents``, with gaps in every column."""
    own = _table(spark, sf_dir, "documents")
    return own.select(
        "doc_id", F.when(F.expr("doc_id % 4 <> 0"), F.concat(F.lit("T"), _text("doc_id"))).alias("title"), F.col("source").alias("section_path"), F.when(F.expr("doc_id % 5 <> 0"), F.concat(F.lit("/d/"), _text("doc_id"))).otherwise("").alias("local_path"),
        F.expr("cast(doc_id % 3 = 0 as int)").alias("needs_review"), F.expr("if(doc_id % 2 = 0, 'pdf', 'docx')").alias("doc_type"), F.expr("if(doc_id % 6 = 0, 'broken file', if(doc_id % 6 = 3, '', null))").alias("extraction_error"), F.expr("doc_id % 7 <> 0").alias("download_ok"), "text",
    )


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.flagged_for_retry(_stored(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 9 <> 0")
def indexable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _stored(spark, sf_dir)
    return store.indexable(own, own.where("doc_id % 9 <> 0").select("local_path")).select("doc_id")


@query("""SELECT doc_id, 'No text could be extracted from this document. Title: ' || CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id ELSE 'unknown' END || '. Section: ' || coalesce(nullif(source, ''), 'unknown') || '. Date: unknown. File: ' || CASE WHEN doc_id % 5 <> 0 THEN '/d/' || doc_id ELSE 'unknown' END || '.' AS text FROM documents""")
def placeholder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("doc_id", extract.placeholder(F.lit("")).alias("text"))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR END AS doc_id, '- **' || CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id ELSE '' END || '** (' || CASE WHEN doc_id % 5 <> 0 THEN '/d/' || doc_id ELSE '' END || '): ' || CASE WHEN doc_id % 6 = 0 THEN 'broken file' ELSE 'low text quality' END AS line FROM documents WHERE doc_id % 3 = 0""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.review_lines(_stored(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))


@query("SELECT doc_id, doc_id % 3 = 0 OR 100000 - doc_id * 100 >= 86400 AS due FROM documents")
def due_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.expr("doc_id % 3 <> 0"), F.col("doc_id") * 100.0)
    return _table(spark, sf_dir, "documents").select("doc_id", store.due(F.lit(100_000.0), last).alias("due"))


@query("SELECT doc_id, doc_id % 6 IN (0, 1) OR doc_id % 10 = 0 OR len(regexp_extract_all(text, '\\S+')) = 0 AS flagged FROM documents")
def office_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr("if(doc_id % 6 = 0, 'broken', if(doc_id % 6 = 1, 'none', ''))").alias("extraction_error"), F.expr("if(doc_id % 4 = 0, doc_id % 10 = 0, if(doc_id % 10 = 0, true, null))").alias("best_effort"), text.word_count(F.col("text")).alias("word_count"))
    return docs.select("doc_id", extract.office_needs_review().alias("flagged"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE w::DOUBLE / (doc_id % 4) < 20 END AS ocr, CASE WHEN doc_id % 2 = 0 AND w > 0 OR doc_id % 2 = 1 AND w < 1 THEN 'ocr' ELSE 'native' END AS chosen FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS w FROM documents)""")
def ocr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("word_count"), F.expr("doc_id % 4").alias("page_count"), F.array("text").alias("pages"), F.expr("if(doc_id % 2 = 0, array(text, text), array('word'))").alias("ocr_pages"))
    return docs.select("doc_id", extract.needs_ocr().alias("ocr"), F.when(extract.better_pages() == F.col("pages"), "native").otherwise("ocr").alias("chosen"))


@query("SELECT l_orderkey AS doc_id, round(coalesce(avg(CASE WHEN l_quantity::INT >= 10 THEN (l_quantity::INT - 10)::DOUBLE END), 0), 6) AS ocr_confidence FROM lineitem GROUP BY 1")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("cast(cast(l_quantity as int) - 10 as double)").alias("conf"))
    return extract.mean_confidence(pages).withColumn("ocr_confidence", F.round("ocr_confidence", 6))


@query(f"""SELECT r.id, r.number AS document_number, coalesce(r.date_raw, '1.1.2000') AS date_raw, coalesce(r.date_parsed, '2000-01-01') AS date_parsed, 2 AS page_count, len(regexp_extract_all(l.text, '\\S+')) + 2 AS word_count FROM ({ORACLES["document_refs"]}) r JOIN ({LETTERS}) l USING (id)""")
def described_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = derived(spark, sf_dir, LETTERS, "orders").select("id", F.array("text", F.lit("second page")).alias("pages"), F.lit("1.1.2000").alias("date_raw"), F.lit("2000-01-01").alias("date_parsed"))
    return extract.described(letters).select("id", "document_number", "date_raw", "date_parsed", "page_count", F.col("word_count").cast("long").alias("word_count"))


@query("""SELECT doc_id || '::chunk' || (i - 1) AS chunk_id, i AS page_start, i AS page_end, last_value(CASE WHEN (i + doc_id) % 3 = 0 THEN i || '.2' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS clause_ref FROM (SELECT doc_id, unnest(range(1, doc_id % 5 + 2)) AS i FROM documents)""")
def clause_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda i: F.concat(F.when((i + F.col("doc_id")) % 3 == 0, F.concat(F.lit("Clause "), i.cast("string"), F.lit(".2 "))).otherwise(""), F.repeat(F.lit("word "), 300))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(1).cast("long"), F.expr("doc_id % 5 + 1")), page).alias("pages"))
    return chunking.chunk_documents(docs).select("chunk_id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "clause_ref")


@query("""SELECT 'u' || l_partkey AS source_url, min(l_orderkey * 10 + l_linenumber) AS discovery_ord FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""")
def first_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("u"), _text("l_partkey")).alias("source_url"), F.expr("l_orderkey * 10 + l_linenumber").alias("discovery_ord"))
    seen = _table(spark, sf_dir, "part").select(F.concat(F.lit("u"), _text("p_partkey")).alias("source_url"), F.expr("p_partkey % 2 = 0").alias("download_ok"))
    return store.first_seen(records, seen)


@query("SELECT count(*) FILTER (doc_id % 7 <> 0) AS ok, count(*) FILTER (doc_id % 7 = 0) AS failed FROM documents")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_summary(_stored(spark, sf_dir).withColumn("download_ok", F.when(F.col("download_ok"), True)))


_EXCERPT = """'[Excerpt ' || n_nationkey || ']' || chr(10) || 'Title: ' || n_name || chr(10) || 'Date: ' || CASE WHEN n_nationkey % 2 = 0 THEN '2020-01-01' ELSE 'unknown' END || chr(10) || 'Notification/Letter No.: ' || CASE WHEN n_nationkey % 3 = 0 THEN 'N/' || n_nationkey ELSE 'not detected' END || chr(10) || 'Section: ' || r_name || chr(10)
 || 'Clause: ' || CASE WHEN n_nationkey % 4 = 0 THEN '4.1' ELSE 'none detected' END || chr(10) || 'Page: ' || CASE n_nationkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '1' ELSE '2-5' END || chr(10) || CASE n_nationkey % 4 WHEN 1 THEN 'Status: SUPERSEDED by note' || chr(10) WHEN 2 THEN 'Status: AMBIGUOUS -- note' || chr(10) ELSE '' END || 'Source URL: http://s/' || n_nationkey || chr(10) || '---' || chr(10) || lower(n_name) || chr(10)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.selectExpr(
        "n_nationkey as rank", "n_name as title", "if(n_nationkey % 2 = 0, '2020-01-01', '') as date", "if(n_nationkey % 3 = 0, concat('N/', n_nationkey), null) as circular_number", "r_name as section_path", "if(n_nationkey % 4 = 0, '4.1', '') as clause_ref",
        "cast(n_nationkey % 3 as int) as page_start", "cast(if(n_nationkey % 3 = 2, 5, n_nationkey % 3) as int) as page_end", "array('current', 'superseded', 'ambiguous', 'amended')[cast(n_nationkey % 4 as int)] as status", "if(n_nationkey % 4 = 3, '', 'note') as status_note", "concat('http://s/', n_nationkey) as source_url", "lower(n_name) as text",
    )


@query(f"SELECT n_nationkey AS rank, {_EXCERPT} AS excerpt FROM nation JOIN region ON n_regionkey = r_regionkey")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("rank", text.excerpt(F.col("rank")).alias("excerpt"))


@query(f"SELECT 'Retrieved excerpts:' || chr(10) || chr(10) || string_agg({_EXCERPT}, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || 'Question: what holds?' AS message FROM nation JOIN region ON n_regionkey = r_regionkey")
def question_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.user_message("what holds?", _hits(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.create_map(F.lit("doc_id"), _text("vec_id % 10"), F.lit("status"), F.lit("current")).alias("metadata"))


@query("SELECT vec_id AS chunk_id, (vec_id % 10)::VARCHAR AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 'superseded' ELSE 'current' END AS status, CASE WHEN vec_id % 3 = 0 THEN 'by ' || vec_id END AS status_note FROM embeddings")
def vector_metadata_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    updates = own.where("chunk_id % 3 = 0").select("chunk_id", F.create_map(F.lit("status"), F.lit("superseded"), F.lit("status_note"), F.concat(F.lit("by "), _text("chunk_id"))).alias("updates"))
    unknown = spark.range(1).select(F.lit(-1).cast("long").alias("chunk_id"), F.create_map(F.lit("status"), F.lit("lost"), F.lit("status_note"), F.lit("x")).alias("updates"))
    return store.update_metadata(own, updates.unionByName(unknown)).selectExpr("chunk_id", "metadata['doc_id'] as doc_id", "metadata['status'] as status", "metadata['status_note'] as status_note")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'current' END AS status FROM embeddings UNION ALL SELECT -1, 'new'")
def vector_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = lambda df: df.withColumn("metadata", F.create_map(F.lit("status"), F.lit("new")))
    incoming = new(_vectors(spark, sf_dir).where("chunk_id % 2 = 0")).unionByName(new(spark.range(1).selectExpr("-1L as chunk_id")))
    return store.upsert(_vectors(spark, sf_dir), incoming, "chunk_id").selectExpr("chunk_id", "metadata['status'] as status")


@query("SELECT count(DISTINCT vec_id) AS vectors FROM embeddings")
def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.vector_count(_vectors(spark, sf_dir))


@query("""SELECT doc_id AS chunk_id, '' AS doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id ELSE '' END AS title, source AS section_path, '' AS date, '' AS source_url, CASE WHEN doc_id % 5 <> 0 THEN '/d/' || doc_id ELSE '' END AS local_path, '' AS clause_ref, '' AS circular_number, 0 AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS page_start, 7 AS page_end FROM documents""")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("doc_id", "date", "source_url", "clause_ref", "circular_number")}
    chunks = _stored(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")).withColumns(none | {"chunk_index": F.lit(None).cast("int"), "page_start": F.expr("if(doc_id % 3 = 0, null, 2)"), "page_end": F.lit(7)})
    chunks = chunks.withColumn("page_start", F.expr("if(chunk_id % 3 = 0, null, 2)"))
    return store.vector_metadata(chunks)


@query(
    f"""WITH s AS ({ORACLES["coverage_summary"]}), sec AS ({ORACLES["coverage_sections"]}),
head AS (SELECT unnest(['# Coverage Report', '', '## Summary', '', '- Documents discovered: **' || discovered || '**', '- Documents downloaded: **' || downloaded || '**', '- Documents extracted/indexed: **' || extracted || '**', '- Documents flagged for manual review: **' || flagged || '**',
 '- Documents with a detected notification/letter number: **' || with_number || '** (' || number_pct || '%)', '', '## Per-section breakdown', '', '| Section | Discovered | Extracted | Flag |', '| --- | ---: | ---: | --- |']) AS line, unnest(range(14)) AS ord FROM s)
SELECT '' AS section, ord, line FROM head UNION ALL SELECT section_path, 1000, '| ' || CASE WHEN section_path = '' THEN '(root)' ELSE section_path END || ' | ' || discovered || ' | ' || extracted || ' | ' || CASE WHEN flag <> '' THEN ' LOW COUNT' ELSE '' END || ' |' FROM sec"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_lines(*_index(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


def _chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return derived(spark, sf_dir, CHUNKS, "lineitem").select("chunk_id", "doc_id", "status", "status_note", none.alias("superseded_by_doc_id"), none.alias("superseded_by_summary"))


@query(_RESOLVE + "SELECT c.chunk_id, c.doc_id, coalesce(f.status, c.status, 'current') AS status, f.note AS status_note, r.superseded_by_doc_id, r.superseded_by_summary FROM chunks c LEFT JOIN fin f USING (chunk_id) LEFT JOIN roll r ON r.doc_id = c.doc_id")
def applied_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.apply_statuses(_chunk_table(spark, sf_dir), _corpus(spark, sf_dir))


@query(_RESOLVE + "SELECT d.doc_id, coalesce(r.superseded_by_doc_id, CASE WHEN d.doc_ord % 4 = 0 THEN 'before' END) AS superseded_by_doc_id, r.superseded_by_summary FROM documents d LEFT JOIN roll r ON r.doc_id = d.doc_id")
def applied_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "orders").selectExpr("concat('D', o_orderkey) as doc_id", "if(o_orderkey % 4 = 0, 'before', null) as superseded_by_doc_id", "cast(null as string) as superseded_by_summary")
    return resolve.apply_rollups(docs, _corpus(spark, sf_dir))


@query(_RESOLVE + "SELECT status, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM fin GROUP BY status")
def ids_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).statuses.groupBy("status").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


_SCORE = "round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * d / mean))), 9)"
_RETRIEVED = f"""
WITH t AS (SELECT doc_id, {_TOKENS.format("text || ' ' || source || ' notes'")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
f AS (SELECT doc_id, len(ws) AS d, len(list_filter(ws, lambda w: w = 'license')) AS f1, len(list_filter(ws, lambda w: w = 'mit')) AS f2 FROM t),
i AS (SELECT greatest(ln((n - count(*) FILTER (f1 > 0) + 0.5) / (count(*) FILTER (f1 > 0) + 0.5)), 1e-6) AS i1, greatest(ln((n - count(*) FILTER (f2 > 0) + 0.5) / (count(*) FILTER (f2 > 0) + 0.5)), 1e-6) AS i2, any_value(mean) AS mean FROM f, s GROUP BY n),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {_SCORE}, doc_id) AS r FROM f, i WHERE f1 > 0 AND f2 > 0 ORDER BY r LIMIT 6),
v AS (SELECT e.vec_id AS id, {_DISTANCE} AS d FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q ORDER BY round(d, 9), id LIMIT 6),
a AS (SELECT id, 1 / (1 + d) AS score, 'vector' AS source, row_number() OVER (ORDER BY round(d, 9), id) AS r FROM v UNION ALL SELECT id, 0.0, 'keyword', r FROM k WHERE id NOT IN (SELECT id FROM v)),
x AS (SELECT a.*, CASE WHEN id % 3 = 0 THEN 'superseded' ELSE 'current' END AS status, documents.source || ' notes' AS title FROM a JOIN documents ON doc_id = id), y AS (SELECT *, count(*) FILTER (status <> 'superseded') OVER () AS n FROM x),
o AS (SELECT id AS chunk_id, title, round(score, 6) AS score, source, status, row_number() OVER (ORDER BY round(score, 9) DESC, source DESC, r, id) AS rank FROM y WHERE n = 0 OR status <> 'superseded')
"""


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").selectExpr(
        "doc_id as chunk_id", "text", "concat(source, ' notes') as title", "source as section_path", "cast(null as string) as date", "concat('http://s/', doc_id) as source_url", "cast(null as string) as local_path", "cast(null as string) as clause_ref",
        "cast(0 as int) as page_start", "cast(doc_id % 4 as int) as page_end", "cast(null as string) as circular_number", "if(doc_id % 3 = 0, 'superseded', null) as status", "cast(null as string) as status_note",
    )
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return retrieval.retrieve(KEYWORDS, chunks, keyword.build_index(chunks), vectors, _query_vector(spark, sf_dir))[0]


@query(_RETRIEVED + "SELECT * FROM o WHERE rank <= 6")
def retrieved_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).select("chunk_id", "title", F.round("score", 6).alias("score"), "source", "status", "rank")


@query(_RETRIEVED + "SELECT rank, title, '' AS date, '' AS circular_number, '' AS clause_ref, NULL::INT AS page_start, nullif(chunk_id % 4, 0)::INT AS page_end, 'http://s/' || chunk_id AS source_url, '' AS local_path, status, '' AS status_note FROM o WHERE rank <= 6")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations(_retrieved(spark, sf_dir)).drop("section_path")
