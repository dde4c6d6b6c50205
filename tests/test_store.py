"""The store's commits, its keyword index and its resolver, against plain rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from clausebase.operators import keyword, resolve, retrieval
from clausebase.schemas import CHUNKS, DOCUMENTS, LENGTHS, POSTINGS, REFS
from clausebase.sources import snapshots
from clausebase.sources.snapshots import CommitConflict, Layout, Store, Transaction
from clausebase.streaming import ingest

ROWS = "doc_id string, value int"


class Killed(Exception):
    pass


def rows_of(state, name):
    return sorted(tuple(r) for r in state.read(name).select("doc_id", "value").collect()) if name in state.tables else []


def put(spark, change, rows, keys):
    ids = spark.createDataFrame([(k,) for k in keys], "doc_id string")
    change.replace("a", spark.createDataFrame(rows, ROWS), ids)
    change.replace("b", spark.createDataFrame([(d, -v) for d, v in rows], ROWS), ids)


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A kill at every write: the old state, then after a repeat the new one."""
    store = Store(spark, str(tmp_path))
    change = store.begin()
    put(spark, change, [("x", 1), ("y", 2)], ["x", "y"])
    change.commit()
    real_write, real_put = Transaction._write, snapshots.Files.put_new
    done, k = False, 0
    while not done:
        left = k
        k += 1

        def count():
            nonlocal left
            if left == 0:
                raise Killed
            left -= 1

        def write(self, *a):
            out = real_write(self, *a)
            count()
            return out

        monkeypatch.setattr(Transaction, "_write", write)
        monkeypatch.setattr(snapshots.Files, "put_new", lambda self, *a: (count(), real_put(self, *a)))
        try:
            change = Store(spark, str(tmp_path)).begin()
            put(spark, change, [("x", 10), ("z", 30)], ["x", "z", "gone"])
            change.commit()
            done = True
        except Killed:
            state = Store(spark, str(tmp_path)).snapshot()
            assert (rows_of(state, "a"), rows_of(state, "b")) == ([("x", 1), ("y", 2)], [("x", -1), ("y", -2)])
    assert k == 5  # two tables, one folder of keys, the manifest, and the run that lived
    state = Store(spark, str(tmp_path)).snapshot()
    assert state.version == 2 and (rows_of(state, "a"), rows_of(state, "b")) == ([("x", 10), ("y", 2), ("z", 30)], [("x", -10), ("y", -2), ("z", -30)])
    monkeypatch.undo()
    assert len(store.clean(keep=1, grace=0)) == 1 + 2 + 3 + 3  # what the killed runs left
    assert rows_of(store.snapshot(), "a") == [("x", 10), ("y", 2), ("z", 30)] and store.versions() == [2]


def test_random_commits_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    store, want = Store(spark, str(tmp_path)), {}
    for step in range(17):
        keys = rng.sample("abcdefghij", rng.randint(0, 4))
        rows = [(k, 100 * step + i) for k in keys if rng.random() < 0.8 for i in range(rng.randint(1, 2))]
        want = {k: v for k, v in want.items() if k not in keys} | {k: [v for d, v in rows if d == k] for k in {d for d, _ in rows}}
        change = store.begin()
        change.replace("a", spark.createDataFrame(rows, ROWS), spark.createDataFrame([(k,) for k in keys], "doc_id string"), Layout(sort=("value",)))
        assert rows_of(change, "a") == sorted((k, v) for k, vs in want.items() for v in vs)
        change.commit()
        entry = store.snapshot().tables["a"]
        assert len(entry["segments"]) <= 3 * 3 and len(entry["replaced"]) <= snapshots.FAN
    assert rows_of(store.snapshot(), "a") == sorted((k, v) for k, vs in want.items() for v in vs)
    old = store.snapshot()
    store.clean(keep=2, grace=0)
    assert rows_of(old, "a") == rows_of(store.snapshot(), "a") and store.versions() == [16, 17]


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = store.begin(), store.begin()
    put(spark, one, [("x", 1)], ["x"])
    put(spark, two, [("y", 2)], ["y"])
    one.commit()
    with pytest.raises(CommitConflict):
        two.commit()
    assert rows_of(store.snapshot(), "a") == [("x", 1)]
    assert store.clean(grace=3600) == []  # the loser's folders may still be in use


def test_lease_of_the_update(spark, tmp_path):
    to = ingest.Store(spark, str(tmp_path))
    clock = [100.0]
    seen = []

    def step():
        seen.append(ingest.run_update(to, [("x", lambda: seen.append("never"))], "other", now=lambda: clock[0])["status"])

    done = ingest.run_update(to, [("extracting", step)], "me", now=lambda: clock[0])
    assert seen == ["busy"] and done["status"] == "done" and done["last_success_at"] == 100.0
    clock[0] += 50
    assert ingest.run_update(to, [("extracting", step)], "me", now=lambda: clock[0])["last_success_at"] == 100.0 and len(seen) == 1
    clock[0] += 100_000
    failed = ingest.run_update(to, [("extracting", lambda: 1 / 0)], "me", now=lambda: clock[0])
    assert failed["status"] == "failed" and failed["last_success_at"] == 100.0
    change = to.begin()  # an updater that died while it held the lease
    change.marks["update"] = '{"lease_until": 200000.0, "owner": "dead"}'
    change.commit()
    assert ingest.run_update(to, [], "me", now=lambda: clock[0])["status"] == "busy"
    clock[0] = 200_001.0
    assert ingest.run_update(to, [], "me", now=lambda: clock[0])["status"] == "done"


def letters(rng, n, batch):
    """Documents that cite each other's numbers, some renumbered or blank in later batches."""
    out = []
    for k in rng.sample(range(8), n):
        number = f"TC-I/2020/{k if rng.random() < 0.85 else (k + 1) % 8}"
        cited = [rng.choice(["In supersession of Circular No. {}", "In partial modification of Clause 2 of Circular No. {}", "In continuation of letter No. {}", "In modification of Clause 3 of Circular No. {}"]).format(f"TC-I/2020/{rng.randrange(8)}") + " dated 01.01.2020." for _ in range(3)]
        long = lambda w: " ".join([w] * 300)
        text = f"No. {number} dated {rng.randint(1, 28)}.{rng.randint(1, 12)}.{2010 + rng.randint(0, 3) + batch}\n\n1. {long('refunds')}\n\n2. {long('fees')}\n\n2.1 {long('detail')} batch {batch}\n\n3. {long('rule')}\n\n" + "\n\n".join(cited)
        out.append((f"d{k}", f"Title {k}", "S", None, None, "u", "p", f"{batch}-{rng.random()}", "pdf", [" "] if rng.random() < 0.1 else [text], 1, 0, None, None))
    return out


def found(spark, state):
    """Statuses and roll-ups of a full resolve from nothing."""
    chunks = state.read("chunks", CHUNKS).withColumn("status", F.lit(None).cast("string"))
    full = resolve.resolve(state.read("documents", DOCUMENTS), chunks, state.read("refs", REFS).withColumn("ref_ord", F.struct("doc_id", "ref_ord")))
    return full, chunks


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    """A store after five batches, with a look at it after each."""
    rng = random.Random(31)
    to = ingest.Store(spark, str(tmp_path_factory.mktemp("store")))
    for batch in range(5):
        state = ingest.ingest_batch(to, spark.createDataFrame(letters(rng, rng.randint(3, 6), batch), ingest.INCOMING), mark=("s", batch))
        full, chunks = found(spark, state)
        want = sorted((r.chunk_id, r.status, r.note, r.winner) for r in full.statuses.collect())
        got = sorted((r.chunk_id, r.status, r.status_note, r.winner) for r in state.read("statuses").collect())
        assert got == want, batch
        assert sorted(tuple(r) for r in state.read("rollups").select("doc_id", "superseded_by_doc_id", "superseded_by_summary").collect()) == sorted(tuple(r) for r in full.rollups.collect())
    assert {r.status for r in to.read("chunks", CHUNKS).collect()} >= {"current", "superseded", "amended"}
    return to


def test_a_committed_batch_is_not_taken_again(spark, ingested):
    before = ingested.snapshot().version
    ingest.ingest_batch(ingested, spark.createDataFrame(letters(random.Random(1), 5, 99), ingest.INCOMING), mark=("s", 4))
    assert ingested.snapshot().version == before


def test_stored_index_equals_a_new_one(spark, ingested):
    state, chunks = ingested.snapshot(), ingested.read("chunks", CHUNKS)
    index = keyword.build_index(chunks)
    assert (state.figures["n_chunks"], state.figures["n_tokens"]) == (index.n_chunks, round(index.n_chunks * index.mean_length))
    assert state.read("lengths", LENGTHS).agg(F.sum("n_chunks")).first()[0] == index.n_chunks
    for question in ("refunds", "rule in", "No. TC-I/2020/3", "detail title", "nothing there", "--", "detail batch"):
        want = [tuple(r) for r in keyword.search(index, question, 40).collect()]
        part = ingest.index_of(state, question)
        got = [tuple(r) for r in keyword.search(part, question, 40).collect()]
        assert [c for c, _ in got] == [c for c, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True)), question


def test_a_question_reads_the_folders_of_its_terms(spark, ingested, capsys):
    state = ingested.snapshot()
    bucket = keyword.bucket_of("refunds")
    ingest.index_of(state, "refunds").postings.explain("formatted")
    scans = [x for x in capsys.readouterr().out.split("\n\n") if "Scan parquet" in x and "postings" in x and "replaced/" not in x]
    assert scans and all(f"PartitionFilters: [isnotnull(bucket" in x and f"= {bucket})" in x for x in scans)
    assert len({r.bucket for r in state.read("postings", POSTINGS).select("bucket").distinct().collect()}) > 10
    for segment in state.tables["postings"]["segments"]:
        own = ingested.parquet(segment).where(F.col("bucket") == bucket)
        assert all(f"/bucket={bucket}/" in r[0] for r in own.select(F.input_file_name()).distinct().collect())


def test_many_questions_equal_one_by_one(spark, ingested):
    chunks = ingested.read("chunks", CHUNKS)
    index = ingest.whole_index_of(ingested.snapshot())
    rng = random.Random(4)
    vectors = spark.createDataFrame([(r.chunk_id, [rng.random() for _ in range(4)]) for r in chunks.select("chunk_id").collect()], "chunk_id string, embedding array<float>")
    asked = [("q1", "refunds", None, [0.1, 0.2, 0.3, 0.4]), ("q2", "list all rule", None, [0.9, 0.1, 0.0, 0.4]), ("q3", "nothing there", False, None), ("q4", "title rule", True, [0.5] * 4), ("q5", "?!", None, [0.0] * 4)]
    questions = spark.createDataFrame(asked, "question_id string, question string, exhaustive boolean, embedding array<float>")
    many = retrieval.retrieve_many(questions, chunks, index, vectors).collect()
    for key, question, exhaustive, vector in asked:
        one, _ = retrieval.retrieve(question, chunks, index, vectors, vector, exhaustive)
        want = [(r["rank"], r.chunk_id, round(r.score, 6), r.source, r.status, r.text) for r in one.orderBy("rank").collect()]
        got = sorted((r["rank"], r.chunk_id, round(r.score, 6), r.source, r.status, r.text) for r in many if r.question_id == key)
        assert [x[1:] for x in got] == [x[1:] for x in want], key
    cases = spark.createDataFrame([("refunds", "tc-i", None, None), ("refunds", "zzz", None, None), ("fees", None, "title", None), ("zz", "tc", None, None)], "question string, expected_number string, expected_keyword string, exhaustive boolean")
    got = {(r.question, r.passed) for r in retrieval.validate(cases, chunks, index).collect()}
    assert got == {("refunds", True), ("refunds", False), ("fees", True), ("zz", False)}


def test_blocks_give_the_same_hits(spark, tmp_path, monkeypatch):
    """Every question over a skewed vocabulary, phrases among them, with few blocks and with many."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(["the", "fee", "refund", "rule", "class", "port", "sea-salt"], [40, 9, 5, 3, 2, 1, 4], k=n))
    chunks = spark.createDataFrame([(f"d{k // 3}", f"c{k:03d}", text(rng.randint(3, 60)), rng.choice(["", "port title"])) for k in range(150)], "doc_id string, chunk_id string, text string, title string")
    index = keyword.build_index(chunks)
    total = round(index.n_chunks * index.mean_length)
    for blocks in (64, 4096):
        monkeypatch.setattr(keyword, "BLOCKS", blocks)
        postings = keyword.postings_of(chunks).persist()
        bounds = keyword.blocks_of(postings).persist()
        for question, limit in (("port", 3), ("the refund", 5), ("sea-salt port", 4), ("class port sea-salt", 2), ("absent port", 3), ("??", 3), ("the", 200)):
            want = [(r.chunk_id, round(r.bm25, 9)) for r in keyword.search(index, question, limit).collect()]
            got = [(r.chunk_id, round(r.bm25, 9)) for r in keyword.search_in_blocks(postings, bounds, index.n_chunks, total, question, limit).collect()]
            assert got == want, (question, blocks)


def test_postings_and_questions_shuffle_no_places(spark, capsys):
    """A chunk's postings are made in its own row; hits are gathered by chunk, not by question."""
    chunks = spark.createDataFrame([("d", "c1", "fee the fee", "rule"), ("d", "c2", "the sea-salt", ""), ("e", "c3", "", None)], "doc_id string, chunk_id string, text string, title string")
    postings = keyword.postings_of(chunks)
    postings.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = {(r.chunk_id, r.term, tuple(r.positions), r.length) for r in postings.collect()}
    assert got == {("c1", "fee", (0, 2), 4), ("c1", "the", (1,), 4), ("c1", "rule", (keyword.TITLE_OFFSET,), 4), ("c2", "the", (0,), 3), ("c2", "sea", (1,), 3), ("c2", "salt", (2,), 3)}
    index = keyword.build_index(chunks)
    questions = spark.createDataFrame([(k, q) for k, q in enumerate(["the", "the the", "sea-salt the", "salt-sea", "fee the absent", "rule fee", "?"])], "question_id int, question string")
    for own in (index, keyword.KeywordIndex(index.postings, index.lengths, index.n_chunks, index.mean_length, postings)):
        many = keyword.search_many(own, questions, 5)
        got = sorted((r.question_id, r["rank"], r.chunk_id, round(r.bm25, 9)) for r in many.collect())
        want = [(q.question_id, k + 1, r.chunk_id, round(r.bm25, 9)) for q in questions.collect() if q.question != "?" for k, r in enumerate(keyword.search(index, q.question, 5).collect())]
        assert got == want
    many.explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(chunk_id" in plan and "hashpartitioning(question_id#" in plan and ", chunk_id#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(question_id" in x)


def test_a_large_batch_is_indexed_in_parts_and_keeps_no_staged_pages(spark, tmp_path, monkeypatch):
    """Parts of the chunks are dealt one after another, each chunk in one part; pages staged for the batch go before that."""
    monkeypatch.setattr(keyword, "SLICE_BYTES", 1)
    parts, pages = [], []
    real_write = Transaction._write

    def write(self, name, rows, layout):
        if name == "postings":
            parts.append(len(rows))
            pages.extend(x for x, _ in self.store.files.listed(f"{tmp_path}/data/staged") if "pages" in spark.read.parquet(f"{tmp_path}/data/staged/{x}").columns)
        return real_write(self, name, rows, layout)

    monkeypatch.setattr(Transaction, "_write", write)
    to = ingest.Store(spark, str(tmp_path))
    rng = random.Random(5)
    for batch in range(2):
        state = ingest.ingest_batch(to, spark.createDataFrame(letters(rng, 6, batch), ingest.INCOMING))
    assert parts == [keyword.MOST_SLICES] * 2 and pages == []
    of = lambda df: sorted((r.chunk_id, r.term, tuple(r.positions), r.length, r.bucket, r.block) for r in df.collect())
    assert of(state.read("postings", POSTINGS)) == of(keyword.postings_of(state.read("chunks", CHUNKS)))


def test_an_index_of_one_live_segment_is_not_written_again(spark, tmp_path):
    to = ingest.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(d, d, f"fee {d}", "") for d in "abc"], "doc_id string, chunk_id string, text string, title string")
    for ids in (["a", "b", "c"], ["a", "b", "c"], ["a"]):
        change = to.begin()
        own = rows.where(F.col("doc_id").isin(ids))
        ingest.replace_index(change, own, own.select("doc_id"))
        state = change.commit()
        want = sorted((r.doc_id, r.term) for r in state.read("postings", POSTINGS).collect())
        before = {s["path"] for s in state.tables["postings"]["segments"]}
        state = ingest.optimise_index(to)
        after = {s["path"] for s in state.tables["postings"]["segments"]}
        assert len(after) == 1 and (after <= before) is (len(ids) == 3) and not state.tables["postings"]["replaced"]
        assert sorted((r.doc_id, r.term) for r in state.read("postings", POSTINGS).collect()) == want


def test_bounds_are_used_only_while_they_hold(spark, ingested, monkeypatch):
    def ids(state):
        return [r.chunk_id for r in ingest.keyword_hits(state, "refunds", 5).collect()]

    calls = []
    monkeypatch.setattr(keyword, "search_in_blocks", lambda *a, f=keyword.search_in_blocks: calls.append(1) or f(*a))
    before = ids(ingested.snapshot())
    assert not calls
    assert ids(ingest.optimise_index(ingested)) == before and calls
    state = ingest.ingest_batch(ingested, spark.createDataFrame(letters(random.Random(77), 3, 50), ingest.INCOMING))
    assert ids(state) == [r.chunk_id for r in keyword.search(keyword.build_index(ingest.chunks_of(state)), "refunds", 5).collect()] and len(calls) == 1


def test_cells_of_vectors(spark, tmp_path):
    import numpy as np

    from clausebase.operators import vectors

    rng = np.random.default_rng(5)
    heart = rng.normal(size=(12, 8)) * 6
    points = [[float(x) for x in heart[i % 12] + rng.normal(size=8)] for i in range(900)]
    rows = spark.createDataFrame([(f"d{i % 40}", i, p) for i, p in enumerate(points)] + [("d1", 5000, None), ("d1", 5001, []), ("d2", 5002, points[3])], "doc_id string, chunk_id long, embedding array<float>").repartition(5)
    to = ingest.Store(spark, str(tmp_path))
    state = ingest.index_vectors(to, rows, 12)
    queries = [(i, points[i]) for i in range(0, 900, 45)]
    exact = {(r.question_id, r.chunk_id, r["rank"]) for r in retrieval.nearest_many(rows, spark.createDataFrame(queries, "question_id long, embedding array<float>"), 6).collect()}
    assert {(r.question_id, r.chunk_id, r["rank"]) for r in ingest.vector_hits(state, queries, 6, 12).collect()} == exact
    some = ingest.vector_hits(state, queries, 6, 2)
    assert len({(r.question_id, r.chunk_id) for r in some.collect()} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    sizes = [r["count"] for r in state.read("vectors").groupBy("cell").count().collect()]
    assert sum(sizes) == 901 and len(sizes) == 12
    change = to.begin()  # a document's vectors are replaced, another's go
    ingest.replace_vectors(change, spark.createDataFrame([("d3", 9000, points[3])], "doc_id string, chunk_id long, embedding array<float>"), spark.createDataFrame([("d3",), ("d2",)], "doc_id string"))
    got = [r.chunk_id for r in ingest.vector_hits(change.commit(), [(1, points[3])], 1, 12).collect()]
    assert got == [9000]
    few = vectors.train(rows.limit(3), 8)
    assert len(few) <= 3 and len(vectors.train(rows.limit(0), 8)) == 0
    assert vectors.search(state.read("vectors"), np.zeros((0, 8)), queries, 6, 2).count() == 0
    with pytest.raises(ValueError, match="cells"):
        vectors.train(rows, 0)
