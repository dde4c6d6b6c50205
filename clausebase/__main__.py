"""Command line: scrape, ingest, resolve, backfill, update, coverage, ask, validate, clean over a store folder.

    python -m clausebase scrape --store DIR --root URL --docs DIR [--delay SECONDS] [--max-pages N] [--index DIR]
    python -m clausebase ingest --store DIR --source DIR [--checkpoint DIR]
    python -m clausebase resolve --store DIR
    python -m clausebase backfill --store DIR
    python -m clausebase update --store DIR --source DIR [--checkpoint DIR]
    python -m clausebase clean --store DIR
    python -m clausebase coverage --store DIR --index FILE
    python -m clausebase ask --store DIR "question" [--exhaustive]
    python -m clausebase validate --store DIR cases.json
"""

from __future__ import annotations

import argparse
import os
import socket
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import keyword, report, retrieval, scrape
from .schemas import CHUNKS, DOCUMENTS
from .sources.extractors import fetch, http_fetcher
from .sources.index import read_cases, read_index, write_index
from .streaming.ingest import Store, backfill_store, index_of, ingest_stream, resolve_store, run_update, whole_index_of


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="clausebase")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scrape", "ingest", "resolve", "backfill", "update", "clean", "coverage", "ask", "validate"):
        command = commands.add_parser(name)
        command.add_argument("--store", required=True)
        if name == "scrape":
            command.add_argument("--root", required=True)
            command.add_argument("--docs", required=True, help="a folder that all executors mount")
            command.add_argument("--delay", type=float, default=1.0)
            command.add_argument("--max-pages", type=int)
            command.add_argument("--index", help="also write the index files here")
        if name in ("ingest", "update"):
            command.add_argument("--source", required=True)
            command.add_argument("--checkpoint")
        if name == "coverage":
            command.add_argument("--index", required=True)
        if name == "ask":
            command.add_argument("question")
            command.add_argument("--exhaustive", action="store_true", default=None)
        if name == "validate":
            command.add_argument("cases")
    return parser


def _index(store: Store, question: str | None = None) -> keyword.KeywordIndex:
    """The stored index, or that part of it which a question needs; of a store without one, an index of its chunks."""
    state = store.snapshot()
    if "postings" not in state.tables:
        return keyword.build_index(store.read("chunks", CHUNKS))
    return whole_index_of(state) if question is None else index_of(state, question)


def _validate(spark: SparkSession, store: Store, path: str) -> int:
    """0 if every case passes."""
    judged = retrieval.validate(read_cases(spark, path), store.read("chunks", CHUNKS), _index(store)).collect()  # a list of questions written by hand
    for row in judged:
        print("PASS" if row["passed"] else "FAIL", row["question"], "--", row["reason"])
    return int(not all(row["passed"] for row in judged))


def _scrape(store: Store, args: argparse.Namespace) -> None:
    """Pages, then files; an interrupted run goes on with the next."""
    scrape.crawl_store(store, args.root, lambda urls: fetch(urls, http_fetcher(30), args.delay), most_pages=args.max_pages)
    state = scrape.download_store(store, args.docs, lambda urls: fetch(urls, http_fetcher(60), args.delay, tries=2))
    found = scrape.found_of(state, args.docs)
    if args.index:
        write_index(found.withColumn("discovered_at", F.lit(None).cast("string")), args.index)
    for ok, n in found.groupBy("download_ok").count().collect():  # three rows at most
        print({True: "downloaded", False: "failed"}.get(ok, "waiting"), n)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("clausebase").getOrCreate()
    store = Store(spark, args.store)
    ingest = lambda: ingest_stream(spark, args.source, store, args.checkpoint or f"{args.store}/stream")
    if args.command == "scrape":
        _scrape(store, args)
    elif args.command == "ingest":
        ingest()
    elif args.command == "resolve":
        print(resolve_store(store))
    elif args.command == "backfill":
        print(backfill_store(store))
    elif args.command == "update":
        state = run_update(store, [("extracting", ingest), ("resolving", lambda: resolve_store(store))], f"{socket.gethostname()}:{os.getpid()}")
        print(state)
        return int(state.get("status") in ("failed", "busy"))
    elif args.command == "clean":
        print(len(store.clean()), "folders removed")
    elif args.command == "coverage":
        for row in report.coverage_lines(read_index(spark, args.index), store.read("documents", DOCUMENTS)).toLocalIterator():
            print(row["line"])
    elif args.command == "ask":
        chunks = store.read("chunks", CHUNKS)
        hits, mode = retrieval.retrieve(args.question, chunks, _index(store, args.question), exhaustive=args.exhaustive)
        print(f"mode: {mode}")
        for row in retrieval.citations(hits).orderBy("rank").toLocalIterator():  # 100 at most
            print(f"[{row['rank']}] {row['title']} ({row['circular_number'] or 'no number'}), clause {row['clause_ref'] or '-'}, {row['status']}")
    else:
        return _validate(spark, store, args.cases)
    return 0


if __name__ == "__main__":
    sys.exit(main())
