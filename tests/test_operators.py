import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from clausebase import registry
from clausebase.operators import chunking, crawl, extract, keyword, report, resolve, retrieval, store
from clausebase.schemas import CHUNKS, DOCUMENTS, with_missing_columns
from clausebase.sources import extractors
from clausebase.streaming import ingest


def words(n):
    return " ".join(f"word{i}" for i in range(n))


def chunks_of(spark, *pages):
    docs = spark.createDataFrame([("d", list(pages))], "doc_id string, pages array<string>")
    return chunking.chunk_documents(docs).orderBy("chunk_index").collect()


def test_chunks_pack_paragraphs(spark):
    got = chunks_of(spark, "\n\n".join([words(80)] * 10))
    assert len(got) >= 2 and all(len(c.text.split()) <= 500 for c in got[:-1])
    assert [c.chunk_index for c in got] == list(range(len(got))) and got[0].chunk_id == "d::chunk0"
    assert chunks_of(spark, "  \n\n ") == [] and len(chunks_of(spark, words(50))) == 1


def test_chunks_cut_long_paragraphs(spark):
    got = chunks_of(spark, " ".join(f"Lamp {i} stands by the harbour wall." for i in range(150)))
    assert len(got) >= 2 and all(len(c.text.split()) <= 550 for c in got)


def test_chunks_know_clause_and_pages(spark):
    got = chunks_of(spark, "1. Lamps are lit at dusk.\n\n2. Oil is bought.", "It is weighed.\n\n3. Wicks are cut.")
    assert [(c.clause_ref, c.page_start, c.page_end) for c in got] == [("1", 1, 2)]
    far = chunks_of(spark, "7. " + words(300), words(300) + "\n\n" + words(300))
    assert [(c.clause_ref, c.page_start, c.page_end) for c in far] == [("7", 1, 1), ("7", 2, 2), ("7", 2, 2)]


def test_packing_against_plain_rules(spark):
    rng = random.Random(3)
    docs = []
    for d in range(25):
        docs.append((str(d), ["\n\n".join(". ".join(f"S{rng.randint(0, 9)} " + words(rng.choice([1, 5, 60, 260])) for _ in range(rng.choice([1, 1, 2, 9]))) for _ in range(rng.randint(1, 12)))]))
    got = chunking.chunk_documents(spark.createDataFrame(docs, "doc_id string, pages array<string>")).collect()
    for doc_id, (page,) in docs:
        own = sorted((c for c in got if c.doc_id == doc_id), key=lambda c: c.chunk_index)
        assert " ".join(" ".join(c.text for c in own).split()) == " ".join(page.split())  # nothing lost, order kept


@pytest.mark.parametrize(
    ("row", "least", "flagged"),
    [((40, 10, False, None, None), 30, True), ((3000, 10, False, None, None), 30, False), ((0, 0, False, None, "x"), 30, True), ((0, 0, False, None, None), 30, True), ((500, 5, True, 30.0, None), 30, True), ((500, 5, True, 85.0, None), 30, False), ((100, 10, False, None, None), 30, True), ((100, 10, False, None, None), 5, False)],
)
def test_quality(spark, row, least, flagged):
    df = spark.createDataFrame([row], "word_count int, page_count int, ocr_used boolean, ocr_confidence double, extraction_error string")
    assert df.select(extract.is_outlier(least)).first()[0] is flagged


DOCS = [("d0", "Refund rules", "Refund of unused tickets goes by No.45/2019 only."), ("d1", "Parcel", "Booking of parcels; café and naïve tickets."), ("d2", "Unused tickets", "Refund here, elsewhere tickets unused."), ("d3", "x", "refund refund refund unused tickets of"), ("d4", "No 45 2019", "of nothing")]


@pytest.mark.parametrize("query", ["refund of unused tickets", "No.45/2019", "cafe", "tickets", '"unused" tickets', "...", "absent"])
def test_keyword_like_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, title, id UNINDEXED)")
    db.executemany("INSERT INTO f(id, title, text) VALUES (?, ?, ?)", DOCS)
    escaped = " ".join(f'"{w}"' for w in query.replace('"', " ").split())
    want = db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ? ORDER BY rank, id LIMIT 10", (escaped,)).fetchall()
    index = keyword.build_index(spark.createDataFrame(DOCS, "chunk_id string, title string, text string"))
    got = [(r.chunk_id, r.bm25) for r in keyword.search(index, query, 10).collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-6)


def chunk_table(spark, rows):
    base = spark.createDataFrame(rows, "chunk_id string, doc_id string, clause_ref string, status string, text string")
    return with_missing_columns(base.withColumns({"title": F.lit("T"), "section_path": F.lit("S"), "source_url": F.lit("u")}), CHUNKS)


def test_status_filter(spark):
    rows = [("a", "d", None, "superseded", "refund rule"), ("b", "d", None, None, "refund rule now"), ("c", "d", None, "amended", "refund other"), ("e", "d", None, "ambiguous", "refund more words")]
    chunks = chunk_table(spark, rows)
    ids = lambda q, c, **k: [r.chunk_id for r in retrieval.retrieve(q, c, keyword.build_index(c), **k)[0].orderBy("rank").collect()]
    assert set(ids("refund", chunks)) == {"b", "c", "e"}
    assert ids("refund", chunks.where("chunk_id = 'a'")) == ["a"]
    assert set(ids("refund", chunks, exhaustive=True)) == {"a", "b", "c", "e"}
    assert retrieval.retrieve("list all refund", chunks, keyword.build_index(chunks))[1] == "exhaustive"
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("e", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    hits = retrieval.retrieve("refund", chunks, keyword.build_index(chunks), vectors, [0.0, 1.0])[0]
    got = hits.orderBy("rank").collect()
    assert [(r.chunk_id, r.source) for r in got][:2] == [("e", "vector"), ("b", "vector")] and got[0].score == 1.0 and got[2].source == "keyword"
    assert retrieval.citations(hits).count() == 3


def resolved(spark, docs, chunks, refs):
    d = spark.createDataFrame(docs, "doc_id string, title string, document_number string, date_parsed string")
    c = chunk_table(spark, [(i, d_, cl, s, "x") for i, d_, cl, s in chunks])
    r = spark.createDataFrame([(k, *x) for k, x in enumerate(refs)], "ref_ord int, doc_id string, relation string, referenced_number string, referenced_clause string")
    found = resolve.resolve(d, c, r)
    return {x.chunk_id: (x.status, x.note, x.winner) for x in found.statuses.collect()}, {x.doc_id: x.superseded_by_doc_id for x in found.rollups.collect()}, found.counters.first().asDict(), resolve.apply_statuses(c, found)


OLD = ("old", "Old", "TC-I/2019/1", "2019-01-01")


def test_resolver_shuffles_chunks_once(spark, capsys):
    """Chunks are joined by document, and statuses and roll-ups are aggregated where they lie."""
    d = spark.createDataFrame([OLD, ("new", "New", "TC-I/2021/9", "2021-06-01")], "doc_id string, title string, document_number string, date_parsed string")
    c = chunk_table(spark, [("o1", "old", "1", None, "x"), ("o2", "old", "2", "superseded", "x"), ("o3", "old", "3", None, "x")])
    r = spark.createDataFrame([(0, "new", "amendment", "TC-I/2019/1", "1"), (1, "new", "supersession", "TC-I/2019/1", None)], "ref_ord int, doc_id string, relation string, referenced_number string, referenced_clause string")
    low = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        resolve.resolve(d, c, r).rollups.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", low)
    assert "Exchange hashpartitioning(chunk_id" not in plan and plan.count("Exchange hashpartitioning(target_id") == 2
    found = resolve.resolve(d, c, r.where("ref_ord = 0"))
    assert [(x.chunk_id, x.status) for x in found.statuses.collect()] == [("o1", "amended")] and found.rollups.count() == 0
    assert [x.doc_id for x in resolve.resolve(d, c, r.where("ref_ord = 1")).rollups.collect()] == ["old"]


def test_resolver(spark):
    new, amend = ("new", "New", "TC-I/2021/9", "2021-06-01"), ("amend", "Amend", "TC-I/2021/2", "2021-01-01")
    two = [("o1", "old", "1", None), ("o2", "old", "2", None)]
    status, roll, n, table = resolved(spark, [OLD, new], two, [("new", "supersession", "tc-i 2019 1", "5")])
    assert status["o1"] == ("superseded", "New (No. TC-I/2021/9) dated 2021-06-01", "new") and roll == {"old": "new"} and n["chunks_superseded"] == 2 and n["documents_fully_superseded"] == 1
    assert {(r.chunk_id, r.status, r.superseded_by_doc_id) for r in table.collect()} == {("o1", "superseded", "new"), ("o2", "superseded", "new")}
    status, roll, n, _ = resolved(spark, [OLD, amend], [("o1", "old", "1", None), ("o4", "old", "4", None), ("o41", "old", "(4.1)", None), ("o5", "old", "41", None)], [("amend", "partial_modification", "TC-I/2019/1", "4")])
    assert set(status) == {"o4", "o41"} and status["o4"][0] == "amended" and "Clause 4" in status["o4"][1] and not roll
    _, _, n, _ = resolved(spark, [OLD, amend], two, [("amend", "amendment", "TC-I/2019/1", None)])
    assert n["skipped_unscoped_partial"] == 1 and n["chunks_amended"] == 0
    status, roll, _, _ = resolved(spark, [OLD, new, amend], two, [("new", "supersession", "TC-I/2019/1", None), ("amend", "amendment", "TC-I/2019/1", "1")])
    assert status["o1"][0] == "ambiguous" and "TC-I/2021/9" in status["o1"][1] and "TC-I/2021/2" in status["o1"][1] and not roll
    _, _, n, _ = resolved(spark, [OLD, new], two, [("new", "continuation", "TC-I/2019/1", None), ("new", "supersession", "Unindexed/1999/1", None), ("old", "supersession", "TC-I/2019/1", None), ("gone", "supersession", "TC-I/2019/1", None)])
    assert (n["informational_skipped"], n["unmatched"], n["refs_checked"]) == (1, 3, 4)
    _, _, n, _ = resolved(spark, [("old", "Old", "TC-I/2021/1", "2021-01-01"), ("src", "S", "X/1", "2019-06-01")], two, [("src", "supersession", "TC-I/2021/1", None)])
    assert n["skipped_date_order"] == 1 and n["chunks_superseded"] == 0
    status, roll, _, _ = resolved(spark, [OLD, ("mid", "M", "M/1", "2020-01-01"), ("latest", "L", "L/1", "2022-01-01")], two, [("mid", "supersession", "TC-I/2019/1", None), ("latest", "supersession", "TC-I/2019/1", None)])
    assert status["o1"][2] == "latest" and roll == {"old": "latest"}
    status, _, _, _ = resolved(spark, [OLD, ("b", "B", "B/1", None), ("a", "A", "A/1", None)], two, [("b", "supersession", "TC-I/2019/1", None), ("a", "supersession", "TC-I/2019/1", None)])
    assert status["o1"][2] == "b"  # a tie: the first reference
    status, roll, _, _ = resolved(spark, [OLD], [("o1", "old", "1", "superseded")], [])
    assert not status and not roll


def test_backfill(spark):
    docs = spark.createDataFrame([("d1", None, None, "2001-01-01"), ("d2", "K/1", "x", "2002-02-02"), ("d3", None, None, None)], "doc_id string, document_number string, date_raw string, date_parsed string")
    chunks = spark.createDataFrame([("d1", 0, "No. TC-I/2020/109/1 New Delhi dated 23.03.2020", None, None), ("d1", 1, "No. Z/9/9", None, None), ("d2", 0, "dated 01.02.2003", "K/1", None)], "doc_id string, chunk_index int, text string, circular_number string, date string")
    d, c, s = extract.backfill(docs, chunks)
    assert {(r.doc_id, r.document_number, r.date_parsed) for r in d.collect()} == {("d1", "TC-I/2020/109/1", "2020-03-23"), ("d2", "K/1", "2003-02-01"), ("d3", None, None)}
    assert {r.circular_number for r in c.where("doc_id = 'd1'").collect()} == {"TC-I/2020/109/1"} and s.first() == (2, 2)


def test_backfill_of_all_letters(spark):
    con, sf_dir = duckdb.connect(), "/root/testdata/sf0.001"
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf_dir}/orders.parquet'")
    got = tuple(registry.queries()["backfill_statistics"](spark, sf_dir).first())
    assert [got] == con.sql(registry.oracle_sql()["backfill_statistics"]).fetchall() and (got[0],) == con.sql("SELECT count(*) FROM orders").fetchall()[0]


def test_index_round_trip(spark, tmp_path):
    from clausebase.schemas import DOC_INDEX
    from clausebase.sources import index

    rows = with_missing_columns(spark.createDataFrame([(f"d{k}", f"title {k}") for k in range(5)], "doc_id string, title string"), DOC_INDEX).repartition(2)
    index.write_index(rows, str(tmp_path))
    assert {(r.doc_id, r.title) for r in index.read_index(spark, f"{tmp_path}/index.json").collect()} == {(f"d{k}", f"title {k}") for k in range(5)}
    (tmp_path / "array.json").write_text('[{"doc_id": "a"},\n {"doc_id": "b"}]')
    assert {r.doc_id for r in index.read_index(spark, f"{tmp_path}/array.json").collect()} == {"a", "b"}
    assert index.read_index(spark, f"{tmp_path}/none.json").count() == 0
    assert index.read_state(spark, f"{tmp_path}/state").first().status == "idle"
    index.write_state(spark, f"{tmp_path}/state", "done", last_success_at=4.0)
    assert index.read_state(spark, f"{tmp_path}/state").first()[:3] == ("done", "", 4.0)


def test_coverage(spark):
    index = spark.createDataFrame([("d1", "A > B", True), ("d2", "A > B", False), ("d3", "C", True)], "doc_id string, section_path string, download_ok boolean")
    docs = with_missing_columns(spark.createDataFrame([("d1", "A > B", "N/1", 1), ("d3", "C", "", 0)], "doc_id string, section_path string, document_number string, needs_review int"), DOCUMENTS)
    lines = [r.line for r in report.coverage_lines(index, docs).collect()]
    assert "- Documents with a detected notification/letter number: **1** (50.0%)" in lines and "| C | 1 | 1 |  LOW COUNT |" in lines
    assert report.coverage_summary(index, docs.limit(0)).first().number_pct is None
    assert report.store_stats(docs, spark.createDataFrame([("amended",), ("current",)], "status string")).first() == (2, 1, 2, 2, 50.0, 50.0, 0, 1)
    assert [r.line for r in report.review_lines(docs.where("needs_review = 0")).collect()] == ["No documents need manual review."]
    assert report.review_lines(docs).count() == 1
    old = spark.createDataFrame([("c", "d", "x", "sum")], "chunk_id string, doc_id string, superseded_by_doc_id string, superseded_by_summary string")
    assert with_missing_columns(old, CHUNKS).select("status", "status_note").first() == ("superseded", "sum")


def test_cases(spark):
    cases = spark.createDataFrame([("q1", "n/1", None), ("q2", "n/2", None), ("q3", None, "Luggage"), ("q4", "n/1", None), ("q5", None, None)], "question string, expected_number string, expected_keyword string")
    cited = spark.createDataFrame([("q1", "XN/1Y", "t"), ("q2", "N/1", "t"), ("q3", None, "the luggage rules"), ("q5", "a", "b")], "question string, circular_number string, title string")
    got = {r.question: (r.passed, r.reason) for r in retrieval.judged_cases(cases, cited).collect()}
    assert [got[f"q{k}"][0] for k in range(1, 6)] == [True, False, True, False, False]
    assert "NOT found" in got["q2"][1] and "no chunks" in got["q4"][1] and "nothing to check" in got["q5"][1]


def test_store(spark):
    stored = spark.createDataFrame([("a", "1", 0, "S"), ("b", "2", 1, None), ("c", "3", 0, None)], "doc_id string, sha1 string, needs_review int, superseded_by_doc_id string")
    incoming = spark.createDataFrame([("a", "1", 0, None), ("b", "2", 0, None), ("c", "x", 0, None), ("d", "4", 0, None)], stored.schema)
    assert {r.doc_id for r in store.changed(incoming, stored).collect()} == {"b", "c", "d"} and store.changed(incoming, stored, force=True).count() == 4
    got = {r.doc_id: (r.sha1, r.superseded_by_doc_id) for r in store.upsert(stored, incoming, "doc_id", carried=["superseded_by_doc_id"]).collect()}
    assert got == {"a": ("1", "S"), "b": ("2", None), "c": ("x", None), "d": ("4", None)}
    vectors = spark.createDataFrame([("v", {"a": "1", "b": "2"})], "chunk_id string, metadata map<string,string>")
    new = spark.createDataFrame([("v", {"b": "3"}), ("w", {"b": "4"})], "chunk_id string, updates map<string,string>")
    assert [r.metadata for r in store.update_metadata(vectors, new).collect()] == [{"a": "1", "b": "3"}]
    now = lambda last, t: spark.range(1).select(store.due(F.lit(float(t)), F.lit(last).cast("double"))).first()[0]
    assert [now(None, 5), now(0.0, 86_400), now(0.0, 5)] == [True, True, False]


def test_crawl(spark):
    root = "http://h/view_section.jsp?lang=0&id=0,1"
    page = lambda k: f"http://h/view_section.jsp?lang=0&id={k}"
    html = {
        root: '<title>Root</title><a href="view_section.jsp?lang=0&id=0,1,100">Circulars</a><a href="view_section.jsp?lang=0&id=0,1,200">Other</a><a href="view_section.jsp?lang=0&id=0,1">self</a><a href="view_section.jsp?lang=0&id=0,12">out</a>',
        page("0,1,100"): '<a href="docs/c1.pdf">One</a><a href="docs/c2.doc"></a><a href="docs/c1.pdf">again</a><a href="view_section.jsp?lang=0&id=0,1,100">self</a>',
        page("0,1,200"): '<a href="view_section.jsp?lang=0&id=0,1,201">Deep</a>',
        page("0,1,201"): '<a href="docs/c1.pdf">late</a><a href="docs/c3.pdf">Three</a>',
    }
    nodes, docs = crawl.crawl_pages(spark.createDataFrame(list(html.items()), "url string, html string"), root)
    assert {(r.id, r.crumb) for r in nodes.collect()} == {("0,1", "Root"), ("0,1,100", "Root > Circulars"), ("0,1,200", "Root > Other"), ("0,1,201", "Root > Other > Deep")}
    records = {r.source_url: r for r in crawl.download_records(docs, "/d").collect()}
    assert {u.rpartition("/")[2]: r.section_path for u, r in records.items()} == {"c1.pdf": "Root > Circulars", "c2.doc": "Root > Circulars", "c3.pdf": "Root > Other > Deep"}
    assert records["http://h/docs/c2.doc"].title == "c2.doc" and records["http://h/docs/c1.pdf"].local_path.startswith("/d/Root/Circulars/One_")


def test_crawl_of_a_chain(spark):
    page = lambda k: f"http://h/view_section.jsp?lang=0&id=0,{k}"
    chain = lambda n: spark.createDataFrame([("http://h/view_section.jsp?lang=0&id=0", f'<a href="{page(1)}">next</a>')] + [(page(k), f'<a href="{page(k + 1)}">next</a><a href="docs/{k}.pdf">d</a>') for k in range(1, n)], "url string, html string").coalesce(1)
    nodes, docs = crawl.crawl_pages(chain(6), "http://h/view_section.jsp?lang=0&id=0")
    assert nodes.select("level").toPandas()["level"].max() == 6 and docs.count() == 5
    with pytest.raises(ValueError, match="deeper"):
        crawl.crawl_pages(chain(4), "http://h/view_section.jsp?lang=0&id=0", most_levels=2)


def test_transcribe_without_page_count(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"), 0), ("b", bytearray(b"y"), 9)], "doc_id string, content binary, page_count int")
    got = {r.doc_id: r.pages for r in extractors.transcribe(files, lambda content, page: f"page {page}", 3).collect()}
    assert got == {"a": ["page 1"], "b": ["page 1", "page 2", "page 3"]}


def test_extractors(spark):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    files = spark.createDataFrame([("a", "docx", bytearray(buffer.getvalue())), ("b", "doc", bytearray(b"")), ("c", "zip", bytearray(b"")), ("d", "docx", bytearray(b"junk"))], "doc_id string, doc_type string, content binary")
    got = {r.doc_id: r for r in extractors.extract_pages(files).collect()}
    assert got["a"].pages == ["Hello\n\ncell"] and got["b"].best_effort and "unsupported" in got["c"].extraction_error and got["d"].extraction_error
    assert extractors.instant_answer(" ", ["", "topic"]) == "topic" and extractors.instant_answer(None, []) is None


def test_auto_update():
    calls = []
    steps = [(n, lambda n=n: calls.append(n)) for n in ("scraping", "extracting", "resolving", "ocr")]
    done = ingest.auto_update({}, steps, now=100.0)
    assert calls == ["scraping", "extracting", "resolving", "ocr"] and done["status"] == "done" and done["last_success_at"] == 100.0
    assert ingest.auto_update(done, steps, now=200.0) is done
    assert ingest.auto_update(done, steps, now=200.0, interval=10)["last_success_at"] == 200.0
    failed = ingest.auto_update({}, [("scraping", lambda: 1 / 0)], now=5.0)
    assert failed["status"] == "failed" and failed.get("last_success_at") is None


def test_ingest(spark, tmp_path):
    import json

    def put(name, *docs):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"title": "T", "section_path": "S", "source_url": "u", "local_path": "p", "doc_type": "pdf", **d}) for d in docs))

    to = ingest.Store(spark, str(tmp_path / "store"))
    put("1.json", {"doc_id": "old", "sha1": "1", "pages": ["No. TC-I/2019/1 dated 01.01.2019\n\n1. The fee is ten. " + words(40)]}, {"doc_id": "blank", "sha1": "2", "pages": [" "]})
    ingest.ingest_stream(spark, str(tmp_path / "in"), to, str(tmp_path / "cp"))
    assert to.read("chunks", CHUNKS).where("doc_id = 'blank'").count() == 1
    put("2.json", {"doc_id": "new", "sha1": "3", "pages": ["No. TC-I/2021/9 dated 01.06.2021\n\nIn supersession of Circular No. TC-I/2019/1 dated 01.01.2019."]}, {"doc_id": "old", "sha1": "1", "pages": ["changed text, same hash"]})
    ingest.ingest_stream(spark, str(tmp_path / "in"), to, str(tmp_path / "cp"))
    status = {r.doc_id: r.status for r in to.read("chunks", CHUNKS).collect()}
    docs = {r.doc_id: r for r in to.read("documents", DOCUMENTS).collect()}
    assert status["old"] == "superseded" and set(docs) == {"old", "new", "blank"} and docs["new"].document_number == "TC-I/2021/9"


def test_windows(spark):
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:50:00", "a", 2.0), ("2020-01-01 01:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.total) for r in ingest.windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_answer_and_command_line(spark, tmp_path, capsys):
    import json

    from clausebase.__main__ import main
    from clausebase.operators.answer import REFUSAL, answer

    chunks = chunk_table(spark, [("a", "d", "1", None, "refund rule")]).withColumn("circular_number", F.lit("N/1"))
    hits, mode = retrieval.retrieve("refund", chunks, keyword.build_index(chunks))
    seen = []
    got = answer("refund", hits, mode, lambda m: seen.append(m) or "yes", [{"role": "user", "content": "before"}])
    assert got.text == "yes" and got.citations.first().circular_number == "N/1" and len(seen[0]) == 2 and len(got.history) == 3
    none = answer("x", hits.limit(0), mode, lambda m: 1 / 0)
    assert none.text == REFUSAL and none.citations.count() == 0
    store_dir = str(tmp_path / "s")
    to = ingest.Store(spark, store_dir)
    to.write("chunks", chunks)
    to.write("documents", with_missing_columns(spark.createDataFrame([("d", "T")], "doc_id string, title string"), DOCUMENTS))
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"question": "refund", "expected_number": "n/1"}]))
    assert main(["validate", "--store", store_dir, str(cases)]) == 0 and "PASS refund" in capsys.readouterr().out
    assert main(["ask", "--store", store_dir, "refund"]) == 0 and "N/1" in capsys.readouterr().out
    assert main(["coverage", "--store", store_dir, "--index", str(tmp_path / "none.json")]) == 0 and "extracted/indexed: **1**" in capsys.readouterr().out
    assert main(["resolve", "--store", store_dir]) == 0 and main(["backfill", "--store", store_dir]) == 0


def test_containing(spark, monkeypatch):
    """Against a plain search: needles of one to many words, cut words at their ends, marks, ties, repeats, and more than a block of short ones."""
    import random

    from clausebase.operators import substring

    rng = random.Random(3)
    vocabulary = ["fee", "the", "refund", "port", "salt", "Rule", "été", "no"]
    texts = [(i, " ".join(rng.choices(vocabulary, [9, 9, 3, 2, 1, 2, 1, 3], k=rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (3, "other port text under a used id"), (62, "A.B, c"), (62, "A.B, c")]
    needles = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 7)))) for k in range(40)] + [(100, "fund the fe"), (101, "ORT SALT RU"), (102, "."), (103, ""), (104, None), (105, "absent words stand here"), (106, "b, C"), (107, "the fee the"), (107, "port"), (None, "the")]
    monkeypatch.setattr(substring, "BLOCK", 3)
    got = sorted(tuple(r) for r in substring.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, needle string")).collect())
    assert got == sorted({(k, i) for k, n in needles for i, t in texts if k is not None and n and t and n.lower() in t.lower()})
    none = spark.createDataFrame([], "item_id long, needle string")
    assert substring.containing(spark.createDataFrame(texts, "doc_id long, text string"), none).count() == 0


def test_indented_index_in_splits(spark, tmp_path):
    """Equal to reading the file whole, for splits of any size, with marks of JSON inside strings."""
    import json

    from clausebase.schemas import DOC_INDEX
    from clausebase.sources import index

    names = [f.name for f in DOC_INDEX]
    rows = [{"doc_id": f"d{k}", "title": rng_title, "download_ok": k % 2 == 0, "http_status": k, "error": None} for k, rng_title in enumerate(["plain", "  },", "a\n  },\n  {b", "[{\"x\": 1}]", "ß \\ \" end", "}]", "", "\u2028"] * 30)]
    for indent, records in ((2, rows), (4, rows), (2, rows[:1]), (2, []), (None, rows)):
        path = tmp_path / f"{indent}-{len(records)}.json"
        path.write_text(json.dumps(records, indent=indent, ensure_ascii=False), encoding="utf-8")
        whole = sorted(map(str, spark.read.schema(DOC_INDEX).option("multiLine", True).json(str(path)).select(names).collect()))
        for size in ("64", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = index.read_index(spark, str(path))
            assert sorted(map(str, got.select(names).collect())) == whole, (indent, size)
            if size == "64" and indent and len(records) > 1:
                assert got.rdd.getNumPartitions() > 50
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == len(rows)


def test_containing_reads_texts_words_once(spark, monkeypatch):
    from clausebase.operators import substring

    read, extract = [], F.regexp_extract_all
    monkeypatch.setattr(substring.F, "regexp_extract_all", lambda c, *a: (read.append(c), extract(c, *a))[1])
    texts = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, "alpha beta gamma"), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([(7, "alpha BETA gamma delta"), (8, "beta gamma delta epsilon")], "item_id long, needle string")
    out = substring.containing(texts, needles)
    assert [tuple(r) for r in out.collect()] == [(7, 1)] and read.count("text") == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the words' plan is cut off, not run again by each use
