"""A crawl whose frontier, visited pages and found documents are tables of the store: what is committed is never fetched again.

Each commit takes the next pages in breadth-first order, so that a crawl that
was killed goes on where its last commit was and ends as an unbroken one does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import breadcrumb
from ..schemas import columns
from ..sources import extractors
from ..sources.snapshots import CommitConflict, Layout, Snapshot, Store, Transaction
from .crawl import download_records, page_links

NODES = columns("id string, url string, crumb string, level int, node_ord string, fetched boolean, page_ok boolean")
FOUND = columns("source_url string, title string, section_path string, menu_id string, level int, node_ord string, link_ord int, download_ok boolean, http_status int, sha1 string, error string, tried_in_run int")
BY_ID, BY_URL = Layout(key="id"), Layout(key="source_url")
#: url to url, content, http_status.
Fetch = Callable[[DataFrame], DataFrame]


def _first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def crawl_store(to: Store, root_url: str, fetch: Fetch, batch: int = 100_000, most_pages: int | None = None) -> Snapshot:
    """Fetches all menu pages below root_url that the store has not visited, batch of them for each commit.

    A page counts as visited once its commit is there, also if it could not be
    fetched.  The first discovery of a menu id or a document counts, in
    breadth-first order.  most_pages ends this call, not the crawl.
    """
    left = most_pages
    while True:
        change = to.begin()
        size = batch if left is None else min(batch, left)
        if size <= 0:
            return to.snapshot()
        n = _visit(change, root_url, fetch, size)
        if n == 0:
            return to.snapshot()
        try:
            change.commit()
        except CommitConflict:
            continue
        left = None if left is None else left - n


def _visit(change: Transaction, root_url: str, fetch: Fetch, size: int) -> int:
    spark = change.store.spark
    root = spark.range(1).select(urls.menu_id(F.lit(root_url)).alias("m")).first()["m"] or "root"
    nodes = change.read("menu_nodes", NODES)
    if "menu_nodes" not in change.tables:
        nodes = spark.createDataFrame([(root, root_url, None, 0, "", False, None)], NODES)
    now = change.stage(nodes.where("not fetched").orderBy("level", "node_ord").limit(size))
    n = now.count()
    if n == 0:
        return 0
    got = fetch(now.select("url").distinct()).select("url", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    pages = change.stage(now.join(got, "url", "left").withColumns({"fetched": F.lit(True), "page_ok": F.col("html").isNotNull(), "crumb": F.coalesce("crumb", urls.page_title(F.col("html"), F.col("id")))}))
    links = change.stage(pages.drop("page_ok").join(page_links(pages.where("page_ok").select("url", "html")).where("kind <> 'other'"), "url").drop("html", "fetched"))

    known = nodes.select("id")
    menu = links.where("kind = 'menu'").where(urls.in_scope(F.col("menu_id"), root)).select(
        F.col("menu_id").alias("id"), F.col("target").alias("url"), breadcrumb(F.col("crumb"), F.col("label"), F.col("menu_id")).alias("crumb"), (F.col("level") + 1).alias("level"),
        F.concat("node_ord", F.format_string("/%06d", F.col("link_ord"))).alias("node_ord"), F.lit(False).alias("fetched"), F.lit(None).cast("boolean").alias("page_ok"),
    )
    new = _first(menu.join(known, "id", "left_anti"), "id", "level", "node_ord")
    rows = change.stage(pages.select(*NODES.names).unionByName(new.select(*NODES.names)))
    change.replace("menu_nodes", rows, rows.select("id"), BY_ID)

    seen = change.read("found_documents", FOUND).select("source_url")
    docs = links.where("kind = 'document'").select(F.col("target").alias("source_url"), F.col("label").alias("title"), F.col("crumb").alias("section_path"), F.col("id").alias("menu_id"), "level", "node_ord", "link_ord")
    first = _first(docs.join(seen, "source_url", "left_anti"), "source_url", "level", "node_ord", "link_ord")
    untried = {f.name: F.lit(None).cast(f.dataType) for f in FOUND if f.name not in first.columns}
    found = change.stage(first.withColumns(untried).select(*FOUND.names))
    change.replace("found_documents", found, found.select("source_url"), BY_URL)
    return n


def menu_of(state: Snapshot) -> DataFrame:
    """Menu pages, those that wait included."""
    return state.read("menu_nodes", NODES)


def found_of(state: Snapshot, docs_dir: str) -> DataFrame:
    """Index records of the found documents, with the outcome of their download."""
    return download_records(state.read("found_documents", FOUND), docs_dir)


def download_store(to: Store, docs_dir: str, fetch: Fetch, batch: int = 10_000) -> Snapshot:
    """Fetches the found documents that have no file yet into docs_dir, a folder that all executors mount; a commit for each batch.

    A file that is there counts as downloaded.  A document that failed is tried
    again by the next call, once.
    """
    change = to.begin()
    run = int(change.marks.get("download_run", 0)) + 1
    change.marks["download_run"] = run
    change.commit()
    while True:
        change = to.begin()
        records = change.read("found_documents", FOUND)
        waits = ~F.coalesce("download_ok", F.lit(False)) & (F.coalesce("tried_in_run", F.lit(0)) < run)
        now = change.stage(download_records(records.where(waits).orderBy("source_url").limit(batch), docs_dir).select("source_url", "local_path"))
        if now.isEmpty():
            return to.snapshot()
        there = change.stage(extractors.landed(now))
        missing = there.where("sha1 is null")
        got = fetch(missing.select(F.col("source_url").alias("url"))).withColumnRenamed("url", "source_url")
        written = extractors.write_files(missing.drop("sha1").join(got, "source_url"))
        status = F.lit(None).cast("int").alias("http_status")
        outcome = change.stage(there.where("sha1 is not null").select("source_url", "sha1", status).unionByName(written))
        ok = F.col("sha1").isNotNull()
        own = records.drop("sha1", "http_status", "download_ok", "error", "tried_in_run").join(outcome, "source_url")
        done = change.stage(own.withColumns({"download_ok": ok, "error": F.when(~ok, "download failed"), "tried_in_run": F.lit(run)}).select(*FOUND.names))
        change.replace("found_documents", done, done.select("source_url"), BY_URL)
        try:
            change.commit()
        except CommitConflict:
            continue
