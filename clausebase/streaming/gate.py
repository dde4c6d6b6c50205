"""Streams of records: repeated ones dropped, and only new versions let through, by state that outlives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSION = "key string, version string, at_micros long"


def first_records(records: DataFrame, key: str = "source_url", at: str = "discovered_at", late: str = "7 days") -> DataFrame:
    """The first record of each key that arrives, and none of those within late of it; of a table one record of each key.

    State is forgotten once the watermark passes it.  Records without a key
    share one.  Records older than the watermark are dropped.
    """
    if not records.isStreaming:
        return records.dropDuplicates([key])
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def _newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, version = before = state.get if state.exists else (-(2**63), None)
    for part in parts:
        for row_at, row_version in zip(part["at_micros"], part["version"]):
            if version is None or (row_at, row_version) > (at, version):
                at, version = int(row_at), row_version
    if (at, version) != tuple(before):
        state.update((at, version))
        if version != before[1]:
            yield pd.DataFrame({"key": [key[0]], "version": [version], "at_micros": [at]})


def new_versions(records: DataFrame, key: str = "doc_id", version: str = "sha1", at: str = "discovered_at") -> DataFrame:
    """key, version, at_micros of a stream's records whose version differs from the key's newest so far; at most one for each key and batch, its newest.

    Newest is the latest time, of equal ones the greatest version.  A late
    record, older than what was seen, changes nothing.  Records without key,
    version or time are dropped.  A key's state is one pair, whatever the number
    of its records.
    """
    rows = records.select(F.col(key).cast("string").alias("key"), F.col(version).cast("string").alias("version"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_micros")).dropna()
    return rows.groupBy("key").applyInPandasWithState(_newest, VERSION, "at_micros long, version string", "append", GroupStateTimeout.NoTimeout)
