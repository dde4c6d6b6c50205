"""Incremental ingestion: a file stream of page texts into the store, one commit for each batch, and the daily update."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.refs import normal_number
from ..functions.text import fence
from ..operators import extract, keyword, resolve, store, vectors
from ..schemas import BLOCKS, CHUNKS, DOCUMENTS, LENGTHS, LINKS, NUMBERS, POSTINGS, REFS, ROLLUPS, STATUSES, columns
from ..sources import snapshots
from ..sources.snapshots import CommitConflict, Layout, Snapshot, Transaction

INCOMING = columns("doc_id string, title string, section_path string, date_raw string, date_parsed string, source_url string, local_path string, sha1 string, doc_type string, pages array<string>, has_text_layer int, ocr_used int, ocr_confidence double, extraction_error string")
#: Folders of the tables that are read by a number's key.
KEY_BUCKETS = 16
BY_KEY = Layout(folders=("key_bucket",), sort=("number_key",))
BY_TERM = Layout(folders=("bucket",), sort=("term", "block"))
PACKED = Layout(folders=("bucket",), sort=("term", "block"), packed="own")
BY_CELL = Layout(folders=("cell",))
BY_DOCUMENT = Layout(sort=("doc_id",))


class Store(snapshots.Store):
    """The store of documents. ``read`` gives chunks and documents with what the resolver found."""

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        state = self.snapshot()
        view = {"chunks": chunks_of, "documents": documents_of}.get(name)
        return view(state) if view and name in state.tables and "statuses" in state.tables else state.read(name, schema)

    def write(self, name: str, df: DataFrame) -> None:
        """One table anew, as a commit of its own."""
        change = self.begin()
        change.overwrite(name, df)
        change.commit()


def ingest_batch(to: Store, incoming: DataFrame, force: bool = False, mark: tuple[str, int] | None = None) -> Snapshot:
    """One batch as one commit: changed documents are described, chunked, indexed and searched for references, their old rows are replaced, and the documents whose status that can change are resolved anew.

    Of several versions of a document in one batch the one with the highest
    sha1 counts.  mark names a stream and the number of its batch: a batch that
    was committed before is skipped.  If another writer commits first, the batch
    is done again on the new state.  Until the commit nothing has changed, after
    it everything.
    """
    while True:
        change = to.begin()
        if mark and change.marks.get(mark[0], -1) >= mark[1]:
            return to.snapshot()
        _apply(change, incoming, force)
        if mark:
            change.marks[mark[0]] = mark[1]
        try:
            return change.commit()
        except CommitConflict:
            continue


def _apply(change: Transaction, incoming: DataFrame, force: bool) -> None:
    before = change.base
    order = Window.partitionBy("doc_id").orderBy(F.desc("sha1"), F.hash("pages"))
    latest = incoming.withColumn("version", F.row_number().over(order)).where("version = 1").drop("version")
    staged = change.stage(extract.described(store.changed(latest, before.read("documents", DOCUMENTS), force)).drop("text"))
    ids = change.stage(staged.select("doc_id"))
    new = staged.withColumn("text", fence(extract.whole_text()))

    none = F.lit(None).cast("string")
    rows = new.withColumns({"needs_review": extract.is_outlier().cast("int"), "indexed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "superseded_by_doc_id": none, "superseded_by_summary": none})
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENTS])
    chunks = extract.chunk_rows(new).select(*CHUNKS.fieldNames())
    refs = extract.ref_rows(new).select(*REFS.fieldNames())
    replace_documents(change, rows, chunks, refs, ids, staged)


def replace_documents(change: Transaction, documents: DataFrame, chunks: DataFrame, refs: DataFrame, ids: DataFrame, staged: DataFrame | None = None) -> None:
    """All that the store holds of ids replaced by the rows given, and what follows from them: links, numbers, keyword index, statuses.

    staged is what documents, chunks and refs, but not ids, are made of; it is removed when these are written.
    """
    documents = change.replace("documents", documents, ids, BY_DOCUMENT)
    chunks = change.replace("chunks", chunks, ids, BY_DOCUMENT)
    refs = change.replace("refs", refs, ids, BY_DOCUMENT)
    if staged is not None:
        change.unstage(staged)
    replace_links(change, documents, refs, ids)
    replace_index(change, chunks, ids)
    resolve_changed(change, ids)


def replace_links(change: Transaction, documents: DataFrame, refs: DataFrame, ids: DataFrame) -> None:
    """Numbers of documents (doc_id, title, document_number, date_parsed) and what their refs look up, for the resolver."""
    bucket = F.pmod(F.xxhash64("number_key"), F.lit(KEY_BUCKETS)).cast("int").alias("key_bucket")
    numbers = documents.select("doc_id", normal_number(F.col("document_number")).alias("number_key"), "date_parsed").where("number_key is not null").select("*", bucket)
    change.replace("numbers", numbers, ids, BY_KEY)
    change.replace("links", resolve.linked(refs, documents).select("*", bucket).select(*LINKS.fieldNames()), ids, BY_KEY)


def replace_index(change: Transaction, chunks: DataFrame, ids: DataFrame) -> None:
    """Postings of chunks (doc_id, chunk_id, text, title), and the corpus figures by what has come and gone."""
    old = change.base.read("lengths", LENGTHS).join(ids, "doc_id", "left_semi")
    change.replace("postings", [keyword.packed_postings(part) for part in keyword.slices(chunks)], ids, PACKED)
    added = change.replace("lengths", keyword.lengths_of(chunks), ids, BY_DOCUMENT)
    for sign, side in ((-1, old), (1, added)):
        n, total = side.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        change.figures["n_chunks"] = change.figures.get("n_chunks", 0) + sign * n
        change.figures["n_tokens"] = change.figures.get("n_tokens", 0) + sign * total
    change.figures["index_version"] = change.version


def resolve_changed(change: Transaction, ids: DataFrame) -> None:
    """Statuses and roll-ups of the documents that a change of ids can touch: those whose number is, or was, that of a changed document or is, or was, named by one.

    Only rows of these numbers are read of numbers and links: their folders,
    and in them the files' ranges.
    """
    before = change.base
    own = lambda state, name, schema: state.read(name, schema).join(ids, "doc_id", "left_semi").select("number_key", "key_bucket")
    keys = own(change, "numbers", NUMBERS)
    for part in (own(before, "numbers", NUMBERS), own(change, "links", LINKS), own(before, "links", LINKS)):
        keys = keys.unionByName(part)
    keys = change.stage(keys.distinct())
    folders = [r[0] for r in keys.select("key_bucket").distinct().collect()]  # KEY_BUCKETS at most
    of_keys = lambda state, name, schema: state.read(name, schema).where(F.col("key_bucket").isin(folders)).join(keys.select("number_key"), "number_key", "left_semi")
    numbers, links = of_keys(change, "numbers", NUMBERS), of_keys(change, "links", LINKS)
    targets = numbers.select("doc_id").union(of_keys(before, "numbers", NUMBERS).select("doc_id")).union(ids.select("doc_id")).distinct()
    targets = change.stage(targets)
    chunks = change.read("chunks", CHUNKS).select("doc_id", "chunk_id", "clause_ref").join(targets, "doc_id", "left_semi")
    statuses, rollups = resolve.resolve_keys(numbers, links, chunks)
    change.replace("statuses", statuses.withColumnRenamed("note", "status_note").select(*STATUSES.fieldNames()), targets, BY_DOCUMENT)
    change.replace("rollups", rollups.select(*ROLLUPS.fieldNames()), targets, BY_DOCUMENT)


def index_vectors(to: Store, rows: DataFrame, cells: int, rounds: int = 10) -> Snapshot:
    """All vectors (doc_id, chunk_id, embedding) anew in cells around new centres, in one commit."""
    centers = vectors.train(rows, cells, rounds=rounds)
    change = to.begin()
    change.overwrite("cells", vectors.center_rows(to.spark, centers))
    change.overwrite("vectors", vectors.assigned(rows, centers), BY_CELL)
    return change.commit()


def replace_vectors(change: Transaction, rows: DataFrame, ids: DataFrame) -> None:
    """The vectors of ids' chunks replaced by rows (doc_id, chunk_id, embedding), in the cells of the centres that there are."""
    change.replace("vectors", vectors.assigned(rows, vectors.centers_of(change.read("cells"))), ids, BY_CELL)


def vector_hits(state: Snapshot, queries: Sequence[tuple], n: int, probes: int) -> DataFrame:
    """question_id, chunk_id, distance, rank of queries (id, vector): ``vectors.search`` over the stored cells."""
    return vectors.search(state.read("vectors"), vectors.centers_of(state.read("cells")), queries, n, probes)


def documents_of(state: Snapshot) -> DataFrame:
    """The document table with the roll-ups."""
    own = state.read("documents", DOCUMENTS).drop("superseded_by_doc_id", "superseded_by_summary")
    return own.join(state.read("rollups", ROLLUPS), "doc_id", "left").select(*DOCUMENTS.fieldNames())


def chunks_of(state: Snapshot) -> DataFrame:
    """The chunk table with statuses and the roll-ups of its documents; a chunk without a status is current."""
    own = state.read("chunks", CHUNKS).drop("status", "status_note", "superseded_by_doc_id", "superseded_by_summary")
    joined = own.join(state.read("statuses", STATUSES).drop("winner"), ["doc_id", "chunk_id"], "left").join(state.read("rollups", ROLLUPS), "doc_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("current"))).select(*CHUNKS.fieldNames())


def optimise_index(to: Store) -> Snapshot:
    """The keyword index as one segment without dead postings, and the bounds of its blocks, which hold until the next change of the index."""
    change = to.begin()
    change.compact("postings", BY_TERM)
    change.overwrite("blocks", keyword.blocks_of(change.read("postings", POSTINGS)), BY_TERM)
    change.figures["index_version"] = change.figures["blocks_version"] = change.version
    return change.commit()


def keyword_hits(state: Snapshot, query: str, limit: int) -> DataFrame:
    """chunk_id, bm25 of a question's hits: by the blocks' bounds if they are up to date, else from all postings of its terms."""
    n, total = int(state.figures.get("n_chunks", 0)), int(state.figures.get("n_tokens", 0))
    if state.figures.get("blocks_version", -1) == state.figures.get("index_version", 0):
        return keyword.search_in_blocks(state.read("postings", POSTINGS), state.read("blocks", BLOCKS), n, total, query, limit)
    return keyword.search(index_of(state, query), query, limit)


def index_of(state: Snapshot, query: str) -> keyword.KeywordIndex:
    """What a question needs of the stored keyword index."""
    return keyword.stored_index(state.read("postings", POSTINGS), int(state.figures.get("n_chunks", 0)), int(state.figures.get("n_tokens", 0)), query)


def whole_index_of(state: Snapshot) -> keyword.KeywordIndex:
    """The stored keyword index, for batches of questions."""
    own, n = state.read("postings", POSTINGS), int(state.figures.get("n_chunks", 0))
    return keyword.KeywordIndex(own.select("chunk_id", "term", F.explode("positions").alias("pos")), own.groupBy("chunk_id").agg(F.first("length").alias("length")), n, state.figures.get("n_tokens", 0) / n if n else 0.0, own)


def resolve_store(to: Store) -> dict[str, int]:
    """Statuses and roll-ups of the whole store anew, in one commit; the counters."""
    change = to.begin()
    documents, chunks = change.read("documents", DOCUMENTS), change.read("chunks", CHUNKS).withColumn("status", F.lit(None).cast("string"))
    found = resolve.resolve(documents, chunks, change.read("refs", REFS).withColumn("ref_ord", F.struct("doc_id", "ref_ord")))
    statuses = found.statuses.join(chunks.select("doc_id", "chunk_id"), "chunk_id").withColumnRenamed("note", "status_note")
    change.overwrite("statuses", statuses.select(*STATUSES.fieldNames()), BY_DOCUMENT)
    change.overwrite("rollups", found.rollups.select(*ROLLUPS.fieldNames()), BY_DOCUMENT)
    change.commit()
    return found.counters.first().asDict()


def backfill_store(to: Store, overwrite: bool = False) -> dict[str, int]:
    """Numbers and dates detected anew from first chunks, and what follows from them, in one commit; the counts."""
    change = to.begin()
    documents, chunks = change.read("documents", DOCUMENTS), change.read("chunks", CHUNKS)
    new_documents, new_chunks, stats = extract.backfill(documents, chunks, overwrite)
    own = ["document_number", "date_raw", "date_parsed"]
    old = documents.select("doc_id", F.struct(*own).alias("old"))
    moved = change.stage(new_documents.join(old, "doc_id").where(~F.struct(*own).eqNullSafe(F.col("old"))).drop("old"))
    ids = moved.select("doc_id").distinct()
    if not ids.isEmpty():
        of = lambda df: df.join(ids, "doc_id", "left_semi").select(*df.columns)
        replace_documents(change, moved.select(*DOCUMENTS.fieldNames()), of(new_chunks), of(change.read("refs", REFS)), ids)
        change.commit()
    return stats.first().asDict()


def ingest_stream(spark: SparkSession, source: str, to: Store, checkpoint: str) -> None:
    """All files that are new in source (JSON lines of INCOMING), once each, then stops."""
    stream = spark.readStream.schema(INCOMING).json(source)
    query = stream.writeStream.foreachBatch(lambda df, batch: ingest_batch(to, df, mark=(checkpoint, batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window, for streams and tables alike."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def auto_update(state: dict, steps: Sequence[tuple[str, Callable[[], None]]], now: float | None = None, interval: float = 86_400) -> dict:
    """Runs the steps (scraping, extracting, resolving, ocr) if the last success is an interval ago; the new state.

    A failure leaves last_success_at as it was.
    """
    now = time.time() if now is None else now
    last = state.get("last_success_at")
    if last is not None and now - last < interval:
        return state
    state = state | {"last_attempt_at": now}
    for name, step in steps:
        state = state | {"status": name, "detail": ""}
        try:
            step()
        except Exception as problem:  # any step's: it becomes the state
            return state | {"status": "failed", "detail": f"{name}: {problem}"}
    return state | {"status": "done", "detail": "", "last_success_at": now}


def run_update(to: Store, steps: Sequence[tuple[str, Callable[[], None]]], owner: str, now: Callable[[], float] = time.time, interval: float = 86_400, lease: float = 21_600) -> dict:
    """``auto_update`` with its state in the store: each change of state is a commit, so of two updaters one gets the lease and the other's run ends.

    A lease that is over (its holder died) can be taken.  The returned state
    says ``busy`` if another updater holds the lease, and is the stored one if
    nothing is due.
    """

    def put(state: dict) -> None:
        while True:
            change = to.begin()
            change.marks["update"] = json.dumps(state)
            try:
                change.commit()
                return
            except CommitConflict:  # a batch was committed meanwhile; the lease is held
                continue

    change = to.begin()
    state = json.loads(change.marks.get("update", "{}"))
    began = now()
    if state.get("lease_until", 0) > began:
        return state | {"status": "busy"}
    last = state.get("last_success_at")
    if last is not None and began - last < interval:
        return state
    held = state | {"owner": owner, "lease_until": began + lease}
    change.marks["update"] = json.dumps(held)
    try:
        change.commit()
    except CommitConflict:
        return state | {"status": "busy"}
    told = [(name, lambda name=name, step=step: (put(held | {"status": name, "detail": ""}), step())) for name, step in steps]
    done = auto_update(held, told, began, interval) | {"lease_until": 0}
    put(done)
    return done
