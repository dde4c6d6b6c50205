"""Registered queries of the engine's operators over the driver's tables, each with its SQL for DuckDB.

Each entry of ``QUERIES`` is filled by the decorator with the name, the
function and the SQL text side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, refs, text, urls
from .operators import chunking, crawl, extract, keyword, report, resolve, retrieval, store, substring
from .plans.corpora import CHUNKS, CIRCULARS, LETTERS, REFS, derived
from .streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> resolve.Resolution:
    documents = derived(spark, sf_dir, CIRCULARS, "orders")
    return resolve.resolve(documents, derived(spark, sf_dir, CHUNKS, "lineitem"), derived(spark, sf_dir, REFS, "orders"), "doc_ord")


_RESOLVE = f"""
WITH documents AS ({CIRCULARS}), chunks AS ({CHUNKS}), refs AS ({REFS}),
key AS (SELECT *, nullif(lower(regexp_replace(document_number, '[^A-Za-z0-9]', '', 'g')), '') AS k FROM documents),
target AS (SELECT k, arg_max(doc_id, doc_ord) AS target_id, arg_max(date_parsed, doc_ord) AS target_date FROM key WHERE k IS NOT NULL GROUP BY k),
cls AS (SELECT r.*, t.target_id, s.date_parsed AS source_date, s.title || ' (No. ' || s.document_number || ') dated ' || s.date_parsed AS source_summary,
 CASE WHEN relation = 'continuation' THEN 'informational' WHEN t.target_id IS NULL OR t.target_id = r.doc_id OR s.doc_id IS NULL THEN 'unmatched' WHEN s.date_parsed < t.target_date THEN 'skipped_date_order'
  WHEN relation = 'supersession' THEN 'full' WHEN coalesce(referenced_clause, '') <> '' THEN 'partial' ELSE 'unscoped' END AS outcome
 FROM refs r LEFT JOIN target t ON t.k = nullif(lower(regexp_replace(r.referenced_number, '[^A-Za-z0-9]', '', 'g')), '') LEFT JOIN documents s ON s.doc_id = r.doc_id),
hit AS (SELECT c.chunk_id, x.*, nullif(lower(trim(trim(c.clause_ref), '().')), '') AS oc, nullif(lower(trim(trim(x.referenced_clause), '().')), '') AS rc FROM cls x JOIN chunks c ON c.doc_id = x.target_id WHERE outcome IN ('full', 'partial')),
prop AS (SELECT chunk_id, ref_ord, source_date, doc_id AS source_id, outcome, CASE outcome WHEN 'full' THEN 'superseded' ELSE 'amended' END AS status,
 CASE outcome WHEN 'full' THEN source_summary ELSE 'Amended (Clause ' || referenced_clause || ') by ' || source_summary END AS note FROM hit WHERE outcome = 'full' OR oc = rc OR starts_with(oc, rc || '.')),
fin AS (SELECT chunk_id, CASE WHEN min(status) = max(status) THEN min(status) ELSE 'ambiguous' END AS status,
 CASE WHEN min(status) = max(status) THEN first(note ORDER BY source_date DESC, ref_ord) ELSE 'Conflicting supersession signals: ' || string_agg(DISTINCT note, '; ' ORDER BY note) END AS note,
 CASE WHEN min(status) = max(status) THEN first(source_id ORDER BY source_date DESC, ref_ord) END AS winner FROM prop GROUP BY chunk_id),
aft AS (SELECT c.doc_id, c.chunk_id, coalesce(f.status, c.status, 'current') AS status, f.note, f.winner FROM chunks c LEFT JOIN fin f USING (chunk_id)),
roll AS (SELECT doc_id, max(winner) AS superseded_by_doc_id, arg_max(note, CASE WHEN winner IS NOT NULL THEN chunk_id END) AS superseded_by_summary FROM aft GROUP BY doc_id HAVING bool_and(status = 'superseded') AND count(DISTINCT winner) = 1)
"""


@query(_RESOLVE + "SELECT * FROM fin")
def resolve_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).statuses


@query(_RESOLVE + "SELECT * FROM roll")
def resolve_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).rollups


@query(
    _RESOLVE
    + """SELECT (SELECT count(*) FROM cls) AS refs_checked, (SELECT count(*) FROM cls WHERE outcome = 'unmatched') AS unmatched, (SELECT count(*) FROM cls WHERE outcome = 'skipped_date_order') AS skipped_date_order,
 (SELECT count(*) FROM cls WHERE outcome = 'unscoped' OR outcome = 'partial' AND ref_ord NOT IN (SELECT ref_ord FROM prop)) AS skipped_unscoped_partial, (SELECT count(*) FROM cls WHERE outcome = 'informational') AS informational_skipped,
 (SELECT count(*) FROM fin WHERE status = 'superseded') AS chunks_superseded, (SELECT count(*) FROM fin WHERE status = 'amended') AS chunks_amended, (SELECT count(*) FROM fin WHERE status = 'ambiguous') AS chunks_ambiguous, (SELECT count(*) FROM roll) AS documents_fully_superseded"""
)
def resolve_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).counters


@query(
    f"""WITH l AS ({LETTERS}), h AS (SELECT id, substr(text, 1, 1500) AS t FROM l),
r AS (SELECT id, nullif(rtrim(regexp_extract(t, '(?i)(?:N\\s?o\\.?|Number)\\s*[:.]?\\s*([A-Za-z0-9][A-Za-z0-9/_.()-]*[0-9][A-Za-z0-9/_.()-]*)', 1), '.,;:'), '') AS number,
 nullif(regexp_extract(t, '(?i)(?:dated|\\bdt\\.?)\\s*[:.,]?\\s*(\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}|\\d{{1,2}}(?:st|nd|rd|th)?\\s+[A-Za-z]{{3,9}}\\.?,?\\s+\\d{{4}})', 1), '') AS date_raw FROM h),
p AS (SELECT *, regexp_extract(date_raw, '(\\d+)[./-](\\d+)[./-](\\d+)', ['d', 'm', 'y']) AS n, regexp_extract(date_raw, '(\\d+)[a-z]*\\s+([A-Za-z]+)\\s+(\\d+)', ['d', 'm', 'y']) AS x FROM r)
SELECT id, CASE WHEN length(number) >= 3 THEN number END AS number, date_raw, CASE WHEN n.d <> '' THEN try_cast(n.y || '-' || lpad(n.m, 2, '0') || '-' || lpad(n.d, 2, '0') AS DATE)::VARCHAR
 WHEN x.d <> '' THEN try_cast(x.y || '-' || lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(x.m[1:3]))::VARCHAR, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE)::VARCHAR END AS date_parsed FROM p"""
)
def document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = derived(spark, sf_dir, LETTERS, "orders")
    return letters.select("id", refs.document_ref(F.col("text")).alias("r")).select("id", "r.number", "r.date_raw", "r.date_parsed")


@query(
    f"""WITH l AS ({LETTERS}), r AS (
SELECT id, 'supersession' AS relation, 'Commercial Circular' AS referenced_label, '' || (id % 90 + 1) AS referenced_number, '2018' AS referenced_year, '01.01.2018' AS referenced_date_raw, NULL AS referenced_clause, 'In supersession of Commercial Circular No. ' || (id % 90 + 1) || ' of 2018 dated 01.01.2018' AS matched_sentence FROM l WHERE contains(text, 'In supersession of')
UNION ALL SELECT id, 'partial_modification', 'Circular', '45/2019', NULL, '12-06-2019', regexp_extract(text, 'Clause (\\d+\\.\\d+)', 1), regexp_extract(text, 'In partial modification of .*12-06-2019') FROM l WHERE contains(text, 'In partial modification of')
UNION ALL SELECT id, 'modification', 'Circular', '9/2017.', NULL, NULL, NULL, 'in modification of Circular 9/2017.' FROM l WHERE contains(text, 'in modification of')
UNION ALL SELECT id, 'amendment', NULL, NULL, NULL, NULL, NULL, 'amends the fare structure notified earlier' FROM l WHERE contains(text, ' amends ')
UNION ALL SELECT id, 'continuation', 'letter', 'TC-II/2020/' || id, NULL, '3rd March 2020', NULL, 'In continuation of letter no. TC-II/2020/' || id || ' dated 3rd March 2020' FROM l WHERE contains(text, 'In continuation of'))
SELECT * FROM r"""
)
def supersession_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = derived(spark, sf_dir, LETTERS, "orders")
    each = letters.select("id", F.explode(refs.references(F.col("text"))).alias("r"))
    return each.select("id", *[f"r.{c}" for c in ("relation", "referenced_label", "referenced_number", "referenced_year", "referenced_date_raw", "referenced_clause", "matched_sentence")])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return chunking.chunk_documents(docs.select("doc_id", F.array(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("pages")))


_PACKED = r"""
WITH RECURSIVE par AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS po FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p, ' ') <> ''),
big AS (SELECT doc_id, po, p, len(regexp_extract_all(p, '\S+')) AS w FROM par),
s1 AS (SELECT doc_id, po, w, CASE WHEN w > 500 THEN string_split(regexp_replace(trim(p, ' '), '([.;:])\s+([A-Z0-9(])', '\1' || chr(30) || '\2', 'g'), chr(30)) ELSE [p] END AS parts, w > 1000 AS split, w > 500 AS cut FROM big),
un AS (SELECT doc_id, po, generate_subscripts(parts, 1) AS so, len(parts) AS ns, len(regexp_extract_all(unnest(parts), '\S+')) AS words, split, cut FROM s1),
u AS (SELECT doc_id, words, cut AND NOT split AS s, so = 1 AS first, so = ns AS last, row_number() OVER (PARTITION BY doc_id ORDER BY po, so) AS n FROM un),
st AS (SELECT doc_id, n, words, 0 AS chunk, CASE WHEN (s AND last) OR (NOT s AND words >= 500) THEN 1 ELSE 0 END AS nxt, CASE WHEN (s AND last) OR (NOT s AND words >= 500) THEN 0 ELSE words END AS cur, NOT ((s AND last) OR (NOT s AND words >= 500)) AS open FROM u WHERE n = 1
UNION ALL SELECT u.doc_id, u.n, u.words,
 st.nxt + CASE WHEN st.open AND CASE WHEN s THEN first OR st.cur + u.words > 500 ELSE st.cur + u.words > 500 AND st.cur >= 200 END THEN 1 ELSE 0 END,
 st.nxt + CASE WHEN st.open AND CASE WHEN s THEN first OR st.cur + u.words > 500 ELSE st.cur + u.words > 500 AND st.cur >= 200 END THEN 1 ELSE 0 END
  + CASE WHEN CASE WHEN s THEN last ELSE CASE WHEN st.open AND (st.cur + u.words > 500 AND st.cur >= 200) THEN 0 ELSE st.cur END + u.words >= 500 END THEN 1 ELSE 0 END,
 CASE WHEN CASE WHEN s THEN last ELSE CASE WHEN st.open AND (st.cur + u.words > 500 AND st.cur >= 200) THEN 0 ELSE st.cur END + u.words >= 500 END THEN 0
  ELSE CASE WHEN st.open AND CASE WHEN s THEN first OR st.cur + u.words > 500 ELSE st.cur + u.words > 500 AND st.cur >= 200 END THEN 0 ELSE st.cur END + u.words END,
 NOT CASE WHEN s THEN last ELSE CASE WHEN st.open AND (st.cur + u.words > 500 AND st.cur >= 200) THEN 0 ELSE st.cur END + u.words >= 500 END
FROM st JOIN u ON u.doc_id = st.doc_id AND u.n = st.n + 1)
"""


@query(_PACKED + "SELECT doc_id || '::chunk' || chunk AS chunk_id, doc_id, chunk AS chunk_index, sum(words)::BIGINT AS n_words FROM st GROUP BY doc_id, chunk")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", text.word_count(F.col("text")).cast("long").alias("n_words"))


KEYWORDS = "license mit"
_TOKENS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"


@query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS.format("text")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
f AS (SELECT doc_id, len(ws) AS d, len(list_filter(ws, lambda w: w = 'license')) AS f1, len(list_filter(ws, lambda w: w = 'mit')) AS f2 FROM t),
i AS (SELECT greatest(ln((n - count(*) FILTER (f1 > 0) + 0.5) / (count(*) FILTER (f1 > 0) + 0.5)), 1e-6) AS i1, greatest(ln((n - count(*) FILTER (f2 > 0) + 0.5) / (count(*) FILTER (f2 > 0) + 0.5)), 1e-6) AS i2, any_value(mean) AS mean FROM f, s GROUP BY n)
SELECT doc_id AS chunk_id, round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * d / mean))), 6) AS bm25 FROM f, i WHERE f1 > 0 AND f2 > 0 ORDER BY round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * d / mean))), 9), doc_id LIMIT 6"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return keyword.search(keyword.build_index(docs, title=False), KEYWORDS, retrieval.SPECIFIC_TOP).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(" + _TOKENS.format("text") + ") AS term FROM documents) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return keyword.term_counts(docs, title=False)


@query("SELECT doc_id AS chunk_id FROM documents WHERE text ILIKE '%license%' ORDER BY doc_id LIMIT 20")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("title"))
    return keyword.like_search(docs, "license", 20).select("chunk_id")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


_DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


@query(f"SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM (SELECT e.vec_id, {_DISTANCE} AS distance FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q) ORDER BY round(distance, 9), vec_id LIMIT 40")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), retrieval.EXHAUSTIVE_TOP, "vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round(retrieval.score(F.col("distance")), 6).alias("score"))


@query(
    f"""WITH v AS (SELECT e.vec_id AS id, {_DISTANCE} AS d FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q ORDER BY round(d, 9), id LIMIT 6),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE contains(lower(text), 'mit license') ORDER BY doc_id LIMIT 6),
a AS (SELECT id, 1 / (1 + d) AS score, 'vector' AS source, row_number() OVER (ORDER BY round(d, 9), id) AS r FROM v UNION ALL SELECT id, 0.0, 'keyword', r FROM k WHERE id NOT IN (SELECT id FROM v)),
s AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'superseded' ELSE 'current' END AS status FROM a), f AS (SELECT *, count(*) FILTER (status <> 'superseded') OVER () AS n FROM s),
o AS (SELECT id AS chunk_id, round(score, 6) AS score, source, status, row_number() OVER (ORDER BY round(score, 9) DESC, source DESC, r, id) AS rank FROM f WHERE n = 0 OR status <> 'superseded')
SELECT * FROM o WHERE rank <= 6"""
)
def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest(_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), _query_vector(spark, sf_dir), retrieval.SPECIFIC_TOP)
    found = _table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("mit license"))).select(F.col("doc_id").alias("chunk_id"), F.lit(0.0).alias("bm25")).orderBy("chunk_id").limit(retrieval.SPECIFIC_TOP)
    hits = retrieval.merge(near, found).withColumn("status", F.when(F.col("chunk_id") % 2 == 0, "superseded").otherwise("current"))
    return retrieval.ranked(hits, False).select("chunk_id", F.round("score", 6).alias("score"), "source", "status", "rank")


@query("SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, coalesce(nullif(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10), '') || text AS query FROM conversations WHERE role = 'user'")
def conversational_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_previous_question(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", "previous", "query")


@query("SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role = 'user') WHERE rank <= 8")
def recent_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.recent_questions(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "rank")


@query(r"SELECT conv_id, turn, regexp_matches(text, '(?i)\b(list\s+all|every\s+circular|all\s+circulars?|summarize\s+all|all\s+rules?\s+on|all\s+of\s+the|complete\s+list)\b') AS exhaustive FROM conversations")
def exhaustive_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_exhaustive(F.col("text")).alias("exhaustive"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order).alias("carried"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    index = docs.select("doc_id", F.col("source").alias("section_path"), (F.col("doc_id") % 7 != 0).alias("download_ok"))
    stored = docs.join(labels, "doc_id").select("doc_id", F.concat("source", F.lit("-"), "lang").alias("section_path"), (1 - F.col("quality")).alias("needs_review"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("N/"), "doc_id")).alias("document_number"), F.when(F.col("toxic") == 1, F.lit("x")).alias("superseded_by_doc_id"))
    return index, stored


@query("""SELECT *, round_even(100 * with_number::DOUBLE / extracted, 1) AS number_pct FROM (SELECT count(*) AS discovered, count(*) FILTER (doc_id % 7 <> 0) AS downloaded FROM documents), (SELECT count(*) AS extracted, count(*) FILTER (quality = 0) AS flagged, count(*) FILTER (doc_id % 3 = 0) AS with_number FROM documents JOIN labels USING (doc_id))""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_summary(*_index(spark, sf_dir))


@query("""SELECT section_path, coalesce(d, 0) AS discovered, coalesce(e, 0) AS extracted, CASE WHEN coalesce(d, 0) <= 2 THEN 'LOW COUNT' ELSE '' END AS flag FROM (SELECT source AS section_path, count(*) AS d FROM documents GROUP BY 1) FULL JOIN (SELECT source || '-' || lang AS section_path, count(*) AS e FROM documents JOIN labels USING (doc_id) GROUP BY 1) USING (section_path)""")
def coverage_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_sections(*_index(spark, sf_dir))


@query("""SELECT total, flagged, sections, chunks, round_even(100 * (total - flagged)::DOUBLE / total, 1) AS coverage_pct, round_even(100 * with_number::DOUBLE / total, 1) AS number_pct, superseded, amended FROM
(SELECT count(*) AS total, count(*) FILTER (quality = 0) AS flagged, count(DISTINCT source || '-' || lang) AS sections, count(*) FILTER (doc_id % 3 = 0) AS with_number, count(*) FILTER (toxic = 1) AS superseded FROM documents JOIN labels USING (doc_id)), (SELECT count(*) AS chunks, count(*) FILTER (turn % 3 = 1) AS amended FROM conversations)""")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 3 == 1, "amended").otherwise("current").alias("status"))
    return report.store_stats(_index(spark, sf_dir)[1], chunks)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents in both versions, some changed or up for review; benchmark items are stored only, pages are new."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), "source")
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_id"), F.sha1(F.col("text").cast("binary")).alias("sha1"), F.lit("benchmark").alias("source"))
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("doc_id"), F.sha1(F.col("html").cast("binary")).alias("sha1"), F.col("url").alias("source"))
    key = F.concat(F.lit("d"), "doc_id").alias("doc_id")
    unreviewed, unlinked = F.lit(0).alias("needs_review"), F.lit(None).cast("string").alias("superseded_by_doc_id")
    stored = docs.select(key, "sha1", "source", (F.col("doc_id") % 5 == 0).cast("int").alias("needs_review"), F.when(F.col("doc_id") % 2 == 0, F.lit("s")).alias("superseded_by_doc_id")).unionByName(items.select("*", unreviewed, unlinked))
    incoming = docs.select(key, F.when(F.col("doc_id") % 7 == 0, F.lit("new")).otherwise(F.col("sha1")).alias("sha1"), "source", unreviewed, unlinked).unionByName(pages.select("*", unreviewed, unlinked))
    return stored, incoming


@query("SELECT 'd' || doc_id AS doc_id FROM documents WHERE text IS NULL OR doc_id % 5 = 0 OR doc_id % 7 = 0 UNION ALL SELECT 'p' || page_id FROM pages")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return store.changed(incoming, stored).select("doc_id")


@query("""SELECT 'd' || doc_id AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE sha1(text) END AS sha1, source, 0 AS needs_review, CASE WHEN doc_id % 2 = 0 THEN 's' END AS superseded_by_doc_id FROM documents
UNION ALL SELECT 'b' || item_id, sha1(text), 'benchmark', 0, NULL FROM benchmark UNION ALL SELECT 'p' || page_id, sha1(html), url, 0, NULL FROM pages""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return store.upsert(stored, incoming, "doc_id", carried=["superseded_by_doc_id"])


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, 0, 'new' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 = 0")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ids = turns.select("conv_id").distinct()
    new = ids.where("conv_id % 10 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("new").alias("text"))
    return store.replace_for(turns, new, ids.where("conv_id % 5 = 0"), "conv_id")


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>.*?</a>', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM a WHERE trim(href) <> '' AND NOT starts_with(trim(href), 'javascript:') AND NOT starts_with(trim(href), '#') GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    each = pages.select("page_id", F.explode(urls.links(F.col("html"))).alias("l"))
    return each.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("l.href").alias("n_targets"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?is)<a\s[^>]*>.*?</a>')) AS a FROM pages),
h AS (SELECT page_id, trim(regexp_extract(a, '(?is)^<a\s(?:[^>]*\s)?href\s*=\s*"([^"]*)"', 1)) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a),
d AS (SELECT page_id, replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS href, replace(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS label FROM h)
SELECT page_id, href, label, count(*) AS n FROM d WHERE href <> '' AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, '#') GROUP BY ALL""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's address and label, references decoded, and how often the page has it."""
    each = _table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("l"))
    return each.groupBy("page_id", F.col("l.href").alias("href"), F.col("l.text").alias("label")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), ''), 'section-' || page_id) AS title FROM pages""")
def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.page_title(F.col("html"), F.col("page_id").cast("string")).alias("title"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), 'section-' || page_id) AS title, CASE WHEN regexp_matches(lower(url), '\.(pdf|docx?|xlsx?)($|[?#])') THEN regexp_extract(lower(url), '\.(pdf|docx|doc|xlsx|xls)', 1) ELSE 'unknown' END AS doc_type FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.page_title(F.col("html"), F.col("page_id").cast("string"), decoded=False).alias("title"), urls.doc_type(F.col("url")).alias("doc_type"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_linenumber <> l_quantity::INT THEN l_linenumber || '-' || l_quantity::INT ELSE '' || l_linenumber END AS pages,
CASE WHEN l_returnflag = 'N' OR l_linenumber = 2 THEN '' ELSE 'Status: ' || CASE l_returnflag WHEN 'R' THEN 'SUPERSEDED by' ELSE 'AMENDED by' END || ' note ' || l_suppkey || chr(10) END AS status_line FROM lineitem""")
def hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    start, end = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")), F.col("l_quantity").cast("int")
    status = F.when(F.col("l_returnflag") == "N", "current").when(F.col("l_returnflag") == "R", "superseded").otherwise("amended")
    note = F.when(F.col("l_linenumber") != 2, F.concat(F.lit("note "), F.col("l_suppkey").cast("string")))
    return items.select("l_orderkey", "l_linenumber", "l_suppkey", text.page_label(start, end).alias("pages"), text.status_line(status, note).alias("status_line"))


@query("""SELECT item_id, n_docs > 0 AS passed, CASE WHEN n_docs = 0 THEN 'no chunks retrieved at all' ELSE 'expected circular found in citations' END AS reason FROM (SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1)""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    pairs = substring.containing(docs, items.select("item_id", F.col("text").alias("needle")))
    cited = docs.select("doc_id", "text").join(substring.small(pairs), "doc_id").select(F.col("item_id").cast("string").alias("question"), F.lit(None).cast("string").alias("circular_number"), F.col("text").alias("title"))
    cases = items.select(F.col("item_id").cast("string").alias("question"), F.lit(None).cast("string").alias("expected_number"), F.col("text").alias("expected_keyword"))
    return retrieval.judged_cases(cases, cited).select(F.col("question").cast("long").alias("item_id"), "passed", "reason")


@query("SELECT doc_id, error OR pages <= 0 OR words / nullif(pages, 0) < 30 OR (ocr AND conf < 50) AS flagged FROM (SELECT doc_id, doc_id % 11 = 0 AS error, doc_id % 6 AS pages, len(regexp_extract_all(text, '\\S+')) AS words, doc_id % 2 = 0 AS ocr, (doc_id % 100)::DOUBLE AS conf FROM documents)")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "broken").alias("extraction_error"), (F.col("doc_id") % 6).alias("page_count"), text.word_count(F.col("text")).alias("word_count"), (F.col("doc_id") % 2 == 0).alias("ocr_used"), (F.col("doc_id") % 100).cast("double").alias("ocr_confidence"))
    return docs.select("doc_id", extract.is_outlier().alias("flagged"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN NULL ELSE '20' || strftime(o_orderdate, '%y-%m-%d') END AS iso FROM orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "orders")
    low = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(low, "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 0, F.lit("35.13.2019")).otherwise(F.concat(F.date_format(low, "dd.MM."), F.lit("20"), F.date_format(low, "yy")))
    return own.select("o_orderkey", dates.parse_date(raw).alias("iso"))


_SITE = "http://site/view_section.jsp?lang=0&id="


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a small site: a root, a page for each region, one for each nation with its suppliers' documents; each also links to itself and out of scope."""
    region, nation, supplier = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    menu = lambda own, label: F.concat(F.lit('<a href="view_section.jsp?lang=0&amp;id='), own, F.lit('">'), label, F.lit("</a>"))
    text = lambda c: F.col(c).cast("string")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), "")
    outward = F.lit('<a href="view_section.jsp?lang=0&amp;id=7">out</a><a href="view_section.jsp?lang=0&amp;id=0">home</a><a href="#x">x</a>')
    root = region.select(F.col("r_regionkey").alias("k"), menu(F.concat(F.lit("0,"), text("r_regionkey")), F.col("r_name")).alias("a")).agg(listed("a").alias("body")).select(F.lit("0").alias("id"), F.concat(F.lit("<title>Site</title>"), "body", outward).alias("html"))
    regions = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"), menu(F.concat(F.lit("0,"), text("n_regionkey"), F.lit(","), text("n_nationkey")), F.col("n_name")).alias("a")).groupBy("r").agg(listed("a").alias("body")).select(F.concat(F.lit("0,"), F.col("r").cast("string")).alias("id"), F.concat("body", outward).alias("html"))
    links = supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("k"), F.concat(F.lit('<a href="docs/'), text("s_suppkey"), F.lit('.pdf">'), F.col("s_name"), F.lit("</a>")).alias("a"))
    nations = nation.join(links, "n_nationkey").groupBy("n_regionkey", "n_nationkey").agg(listed("a").alias("body")).select(F.concat(F.lit("0,"), text("n_regionkey"), F.lit(","), text("n_nationkey")).alias("id"), F.concat("body", outward).alias("html"))
    return root.unionByName(regions).unionByName(nations).select(F.concat(F.lit(_SITE), "id").alias("url"), "html")


@query("""SELECT '0' AS id, 'Site' AS crumb, 0 AS level UNION ALL SELECT '0,' || r_regionkey, 'Site > ' || r_name, 1 FROM region UNION ALL SELECT '0,' || r_regionkey || ',' || n_nationkey, 'Site > ' || r_name || ' > ' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def menu_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_pages(_site(spark, sf_dir), _SITE + "0")[0].select("id", "crumb", "level")


@query("""SELECT sha1('http://site/docs/' || s_suppkey || '.pdf') AS doc_id, s_name AS title, 'Site > ' || r_name || ' > ' || n_name AS section_path, '0,' || r_regionkey || ',' || n_nationkey AS menu_id, 'pdf' AS doc_type,
'/d/Site/' || replace(r_name || '/' || n_name, '#', '#') || '/' || s_name || '_' || substr(sha1('http://site/docs/' || s_suppkey || '.pdf'), 1, 8) || '.pdf' AS local_path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def crawled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crawl.crawl_pages(_site(spark, sf_dir), _SITE + "0")[1]
    return crawl.download_records(docs, "/d").select("doc_id", "title", "section_path", "menu_id", "doc_type", "local_path")


@query("SELECT item_id, rank FROM (SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank = 1")
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.row_number().over(order).alias("rank")).where("rank = 1")


@query(f"SELECT count(*) AS checked, count(*) FILTER (number IS NOT NULL OR date_parsed IS NOT NULL) AS updated FROM ({ORACLES['document_refs']})")
def backfill_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = derived(spark, sf_dir, LETTERS, "orders")
    chunks = letters.select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("string").alias("circular_number"), F.lit(None).cast("string").alias("date"))
    docs = chunks.select("doc_id", F.lit(None).cast("string").alias("document_number"), F.lit(None).cast("string").alias("date_raw"), F.lit(None).cast("string").alias("date_parsed"))
    return extract.backfill(docs, chunks)[2]
