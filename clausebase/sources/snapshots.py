"""Tables that change together: Parquet folders under one numbered manifest.

A commit writes new folders and then one manifest, ``commits/<version>.json``,
that names every folder of every table; the manifest is put in place by a
rename that fails if another writer took the number.  A reader takes the
highest manifest and sees all of a commit or nothing.  Nothing is overwritten.

A table is a list of segments.  Replacing the rows of some keys adds a segment
and a folder of those keys: a row is alive unless its key was replaced after the
commit that wrote it.  Four segments of one level are merged into one of the
next, without their dead rows, so that a row is rewritten about log4(commits)
times; once a table is a single segment its replaced keys are forgotten.
"""

from __future__ import annotations

import copy
import gc
import json
import tempfile
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import with_missing_columns

FAN = 4
#: Column of the commit that wrote a row.
AT = "written_at_version"


class CommitConflict(Exception):
    """Another writer committed first; the work must be done again on the new state."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one on a local master, and an error on a cluster, whose machines don't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="clausebase-")


class Files:
    """The few file operations that Spark's readers and writers lack, by Hadoop's file system of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._path(folder).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def listed(self, folder: str) -> list[tuple[str, float]]:
        """Names and times of change (seconds) of what is in a folder; nothing if there is no such folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(folder))]

    def put_new(self, path: str, text: str) -> None:
        """Writes a file that isn't there yet, whole or not at all."""
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(part), self._path(path), options)
        except Exception as problem:
            self.delete(part)
            if "FileAlreadyExists" in str(problem):
                raise CommitConflict(path) from None
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Layout:
    """How a table's segments are laid out: folders by a column, rows sorted within files, the key by which rows are replaced, and the array of structs that new rows hold until they have been dealt to folders."""

    key: str = "doc_id"
    folders: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    packed: str | None = None


@dataclass
class Snapshot:
    """One version of all tables."""

    store: Store
    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    marks: dict[str, int | str] = field(default_factory=dict)
    figures: dict[str, float] = field(default_factory=dict)

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The live rows of a table; no rows of schema if it was never written. Columns that a segment was written without get their default."""
        entry = self.tables.get(name)
        if not entry or not entry["segments"]:
            if schema is None:
                raise KeyError(f"no table {name}")
            return self.store.spark.createDataFrame([], schema)
        rows = self._alive(entry, entry["segments"]).drop(AT)
        return rows if schema is None else with_missing_columns(rows, schema)

    def _alive(self, entry: dict, segments: Sequence[dict]) -> DataFrame:
        latest = max([0, *(r["at"] for r in entry["replaced"])])
        settled = [s for s in segments if s["low"] >= latest]
        older = [s for s in segments if s["low"] < latest]
        parts = [self.store.parquet(s) for s in settled]
        if older:
            rows = self._all([self.store.parquet(s) for s in older])
            gone = self._all([self.store.parquet(r) for r in entry["replaced"]]).groupBy(entry["key"]).agg(F.max(AT).alias("replaced_last"))
            kept = rows.join(gone, entry["key"], "left").where(F.col("replaced_last").isNull() | (F.col("replaced_last") <= F.col(AT)))
            parts.append(kept.select(*rows.columns))
        return self._all(parts)

    @staticmethod
    def _all(parts: Sequence[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def folders(self) -> set[str]:
        return {x["path"] for e in self.tables.values() for x in [*e["segments"], *e["replaced"]]}


class Transaction(Snapshot):
    """A version in the making: reads see its own changes, others don't until it is committed."""

    def __init__(self, base: Snapshot):
        super().__init__(base.store, base.version + 1, copy.deepcopy(base.tables), dict(base.marks), dict(base.figures))
        self.base = base
        self._keys: dict[DataFrame, dict] = {}
        self._staged: dict[DataFrame, str] = {}

    def _write(self, name: str, rows: DataFrame | Sequence[DataFrame], layout: Layout) -> dict:
        path = f"data/{name}/{uuid.uuid4().hex}"
        parts = [rows] if isinstance(rows, DataFrame) else rows
        for part in parts:
            if layout.folders:
                part = part.hint("rebalance", *layout.folders)  # a folder with a third of all rows is written by several tasks
            if layout.packed in part.columns:
                part = part.select(*[c for c in part.columns if c != layout.packed], F.inline(layout.packed))
            schema = part.schema.json()
            if layout.sort:
                part = part.sortWithinPartitions(*layout.folders, *layout.sort)
            part.write.mode("append").option("compression", "zstd").partitionBy(*layout.folders).parquet(f"{self.store.folder}/{path}")
            if len(parts) > 1:
                self._release()
        return {"path": path, "schema": schema}

    def _release(self) -> None:
        """Shuffle files of writes that have ended go now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.store.spark.sparkContext._jvm.System.gc()

    def _entry(self, name: str, layout: Layout) -> dict:
        return self.tables.setdefault(name, {"key": layout.key, "segments": [], "replaced": []})

    def _add(self, name: str, rows: DataFrame | Sequence[DataFrame], layout: Layout) -> DataFrame:
        parts = [rows] if isinstance(rows, DataFrame) else rows
        written = self._write(name, [part.withColumn(AT, F.lit(self.version)) for part in parts], layout)
        self.tables[name]["segments"].append(written | {"level": 0, "low": self.version})
        return self.store.parquet(written).drop(AT)

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows written to a folder that no manifest names, and read from there: what several writes of a transaction are made of."""
        written = self._write("staged", rows, Layout())
        staged = self.store.parquet(written)
        self._staged[staged] = written["path"]
        return staged

    def unstage(self, staged: DataFrame) -> None:
        """Removes the folder of staged rows once all that is made of them is written, and the shuffle files of what is written."""
        self.store.files.delete(f"{self.store.folder}/{self._staged.pop(staged)}")
        self._release()

    def replace(self, name: str, rows: DataFrame | Sequence[DataFrame], keys: DataFrame, layout: Layout | None = None) -> DataFrame:
        """All stored rows of keys give way to rows; keys without rows lose theirs. Once for each table of a transaction. The rows as they were written.

        Rows in several parts are written one part after another, so that the shuffle files of one are there at a time.
        """
        layout = layout or Layout()
        entry = self._entry(name, layout)
        if entry["segments"]:
            if keys not in self._keys:  # one folder for all tables that replace the same keys
                self._keys[keys] = self._write("replaced", keys.select(layout.key).distinct().withColumn(AT, F.lit(self.version)), Layout())
            entry["replaced"].append(self._keys[keys] | {"at": self.version})
        added = self._add(name, rows, layout)
        self._merge(name, layout)
        return added

    def overwrite(self, name: str, rows: DataFrame, layout: Layout | None = None) -> None:
        """A table anew."""
        layout = layout or Layout()
        self.tables[name] = {"key": layout.key, "segments": [], "replaced": []}
        self._add(name, rows, layout)

    def compact(self, name: str, layout: Layout | None = None) -> None:
        """A table as one segment without dead rows; nothing is written if one of its segments holds all live rows."""
        entry = self._entry(name, layout or Layout())
        latest = max([0, *(r["at"] for r in entry["replaced"])])
        settled, older = ([s for s in entry["segments"] if (s["low"] >= latest) is x] for x in (True, False))
        if len(settled) == 1 and (not older or self._alive(entry, older).isEmpty()):
            entry["segments"], entry["replaced"] = settled, []
        elif entry["segments"]:
            self.overwrite(name, self.read(name), layout)

    def _merge(self, name: str, layout: Layout) -> None:
        entry = self.tables[name]
        level = 0
        while len(same := [s for s in entry["segments"] if s["level"] == level]) >= FAN:
            merged = self._write(name, self._alive(entry, same), layout)
            merged |= {"level": level + 1, "low": min(s["low"] for s in same)}
            entry["segments"] = [s for s in entry["segments"] if s["level"] != level] + [merged]
            level += 1
        if len(entry["segments"]) == 1 and level:
            entry["replaced"] = []
        elif len(entry["replaced"]) > FAN:
            keys = self._all([self.store.parquet(r) for r in entry["replaced"]]).groupBy(entry["key"]).agg(F.max(AT).alias(AT))
            entry["replaced"] = [self._write("replaced", keys, Layout()) | {"at": max(r["at"] for r in entry["replaced"])}]

    def commit(self) -> Snapshot:
        body = {"version": self.version, "tables": self.tables, "marks": self.marks, "figures": self.figures}
        self.store.files.put_new(f"{self.store.folder}/commits/{self.version:020d}.json", json.dumps(body))
        return self.store.snapshot(self.version)


class Store:
    """A folder of tables and manifests. Any number of readers; of writers that meet, the later one gets ``CommitConflict``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def parquet(self, written: dict) -> DataFrame:
        """A folder that a transaction wrote; its schema is kept with it, so that one without rows can be read."""
        return self.spark.read.schema(T.StructType.fromJson(json.loads(written["schema"]))).parquet(f"{self.folder}/{written['path']}")

    def versions(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name, _ in self.files.listed(f"{self.folder}/commits") if name.endswith(".json") and not name.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The highest version, or a given one that is still kept; an empty one if nothing was ever committed."""
        if version is None:
            known = self.versions()
            if not known:
                return Snapshot(self)
            version = known[-1]
        body = json.loads(self.spark.read.text(f"{self.folder}/commits/{version:020d}.json", wholetext=True).first()[0])
        return Snapshot(self, body["version"], body["tables"], body["marks"], body["figures"])

    def begin(self) -> Transaction:
        return Transaction(self.snapshot())

    def clean(self, keep: int = 2, grace: float = 86_400, now: float | None = None) -> list[str]:
        """Removes all but the last manifests, and folders that none of them names; returns those.

        A folder younger than grace seconds may belong to a commit in the
        making and stays; so does everything until something is committed.
        """
        now = time.time() if now is None else now
        known = self.versions()
        if not known:
            return []
        named = set().union(*(self.snapshot(v).folders() for v in known[-keep:]))
        for version in known[:-keep]:
            self.files.delete(f"{self.folder}/commits/{version:020d}.json")
        gone = []
        for table, _ in self.files.listed(f"{self.folder}/data"):
            for name, changed in self.files.listed(f"{self.folder}/data/{table}"):
                path = f"data/{table}/{name}"
                if path not in named and now - changed >= grace:
                    self.files.delete(f"{self.folder}/{path}")
                    gone.append(path)
        return gone
