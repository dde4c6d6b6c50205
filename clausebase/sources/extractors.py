"""Plug-ins for what needs a library, a model or a network: file formats, OCR, embeddings, fetching, answering.

Each is a small protocol; the engine distributes calls over partitions and
turns failures into error columns, so one bad file fails no task.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import os
import re
import time
import urllib.request
import uuid
import zipfile
from collections import deque
from collections.abc import Iterator, Sequence
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PageExtractor(Protocol):
    def __call__(self, content: bytes, doc_type: str) -> Sequence[str]: ...


class PageTranscriber(Protocol):
    def __call__(self, content: bytes, page: int) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Fetcher(Protocol):
    def __call__(self, url: str) -> tuple[bytes, int] | None: ...


# fixed values: formats, and what is said of files that can't be read
OFFICE = ("docx", "xlsx")
LEGACY = {"doc": "legacy .doc format is not supported", "xls": "legacy .xls format is not supported"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of the body, then non-blank table cells, with a blank line between."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    line = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    outer = [line(p) for p in body.findall(f"{_W}p")]
    cells = ["\n".join(line(p) for p in cell.findall(f"{_W}p")) for table in body.findall(f"{_W}tbl") for cell in table.iter(f"{_W}tc")]
    return "\n\n".join(x for x in [*outer, *cells] if x.strip())


def xlsx_text(content: bytes) -> str:
    """A header line for each sheet, then its rows' non-empty cells joined by bars."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    read = lambda name: ElementTree.fromstring(book.read(name))
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in read("xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in read("xl/workbook.xml").iter(f"{_S}sheet"):
        out.append(f"--- Sheet: {sheet.get('name')} ---")
        target = targets[sheet.get(_R)].lstrip("/")
        for row in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            values = []
            for c in row.findall(f"{_S}c"):
                v = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else None
                value = inline if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if value not in (None, ""):
                    values.append(value)
            if values:
                out.append(" | ".join(values))
    return "\n".join(out)


def office_pages(content: bytes, doc_type: str) -> list[str]:
    return [docx_text(content) if doc_type == "docx" else xlsx_text(content)]


def extract_pages(files: DataFrame, pdf: PageExtractor | None = None) -> DataFrame:
    """doc_id, pages, extraction_error, best_effort from files (doc_id, doc_type, content binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, kind, content in zip(batch["doc_id"], batch["doc_type"], batch["content"], strict=True):
                pages, error, rough = [], None, kind in LEGACY
                try:
                    if kind in LEGACY:
                        error = LEGACY[kind]
                    elif kind in OFFICE:
                        pages = office_pages(content, kind)
                    elif kind == "pdf" and pdf is not None:
                        pages = [p or "" for p in pdf(content, kind)]
                    else:
                        error = f"unsupported doc_type: {kind}"
                except Exception as problem:  # any library's: one bad file becomes a value
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((doc_id, pages, error, rough))
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "extraction_error", "best_effort"])

    return files.select("doc_id", "doc_type", "content").mapInPandas(run, "doc_id string, pages array<string>, extraction_error string, best_effort boolean")


def transcribe(files: DataFrame, transcriber: PageTranscriber, most_pages: int) -> DataFrame:
    """doc_id, pages from files (doc_id, content, page_count); a page that fails is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content, n in zip(batch["doc_id"], batch["content"], batch["page_count"], strict=True):
                pages = []
                for page in range(1, min(max(int(n), 1), most_pages) + 1):
                    try:
                        pages.append(transcriber(content, page) or "")
                    except Exception:  # any service's: the page stays empty
                        pages.append("")
                rows.append((doc_id, pages))
            yield pd.DataFrame(rows, columns=["doc_id", "pages"])

    return files.select("doc_id", "content", "page_count").mapInPandas(run, "doc_id string, pages array<string>")


def embed(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunk_id, embedding of unit norm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder(list(batch["text"])) if len(batch) else []
            unit = [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in vectors]
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "embedding": unit})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")


def fetch(urls: DataFrame, fetcher: Fetcher, delay: float = 1.0, tries: int = 5, backoff: float = 1.5, tasks: int | None = None) -> DataFrame:
    """url, content, http_status; null where every try failed.

    All addresses of a host go to one task, so that at least delay seconds lie
    between its requests; hosts are fetched side by side in as many tasks as
    given (default: the session's shuffle partitions), and one task's hosts take
    turns.  A try that failed waits its backoff while others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            queues: dict[str, deque] = {}
            for url, host in zip(batch["url"], batch["host"]):
                queues.setdefault(host, deque()).append((url, 0))
            ready = [(last.get(host, -delay) + delay, host) for host in queues]
            heapq.heapify(ready)
            rows = []
            while ready:
                at, host = heapq.heappop(ready)
                time.sleep(max(0.0, at - time.monotonic()))
                last[host] = time.monotonic()
                url, k = queues[host].popleft()
                try:
                    got = fetcher(url)
                except Exception:  # any client's: tried again, then null
                    got = None
                wait = delay
                if got is None and k + 1 < tries:
                    queues[host].appendleft((url, k + 1))
                    wait += backoff * 2**k
                else:
                    rows.append((url, *(got or (None, None))))
                if queues[host]:
                    heapq.heappush(ready, (last[host] + wait, host))
            yield pd.DataFrame(rows, columns=["url", "content", "http_status"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    dealt = urls.select("url", host.alias("host")).repartition(tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host")
    return dealt.mapInPandas(run, "url string, content binary, http_status int")


def http_fetcher(timeout: float = 30) -> Fetcher:
    """Content and status of an address by the standard library; any failure raises."""

    def get(url: str) -> tuple[bytes, int]:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as answer:
            return answer.read(), answer.status

    return get


def landed(rows: DataFrame) -> DataFrame:
    """rows with sha1 of the file at local_path, null if there is none; the folder is one that all executors mount."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = []
            for path in batch["local_path"]:
                try:
                    with open(path, "rb") as file:
                        own.append(hashlib.file_digest(file, "sha1").hexdigest())
                except FileNotFoundError:
                    own.append(None)
            yield batch.assign(sha1=own)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("sha1", T.StringType())]))


def write_files(rows: DataFrame) -> DataFrame:
    """Writes content to local_path where it isn't null: source_url, sha1, http_status. A file gets its name when it is whole, so a task that is run again does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = []
            for path, content in zip(batch["local_path"], batch["content"]):
                if content is None:
                    own.append(None)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with open(part, "wb") as file:
                    file.write(content)
                os.replace(part, path)
                own.append(hashlib.sha1(content).hexdigest())
            yield pd.DataFrame({"source_url": batch["source_url"], "sha1": own, "http_status": batch["http_status"].astype("Int32")})

    return rows.select("source_url", "local_path", "content", "http_status").mapInPandas(run, "source_url string, sha1 string, http_status int")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """local_path, content, sha1 of landed files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("local_path"), "content", F.sha1("content").alias("sha1"))


def instant_answer(abstract: str | None, topics: Sequence[str]) -> str | None:
    """The abstract if it says anything, else the first topic that does."""
    return next((x.strip() for x in [abstract or "", *topics] if re.search(r"\S", x)), None)
