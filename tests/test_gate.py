"""Stream state over restarts, with late and repeated records, against plain passes."""

import json
import random

from pyspark.sql import functions as F

from clausebase.streaming import gate

SCHEMA = "doc_id string, sha1 string, discovered_at timestamp"


def run(spark, source, out, of):
    """All files that are new in source, one for each batch; a new query on the old checkpoint each time."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    of(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()


def put(source, name, rows):
    (source / name).write_text("".join(json.dumps({"doc_id": d, "sha1": s, "discovered_at": at}) + "\n" for d, s, at in rows))


def test_new_versions_over_restarts(spark, tmp_path):
    source, dice = tmp_path / "in", random.Random(5)
    source.mkdir()
    newest, expected = {}, []
    for k in range(4):
        rows = [(dice.choice("abcdef"), dice.choice("uvw"), f"2024-01-{dice.randrange(1, 28):02d}T00:00:00Z") for _ in range(8)]
        rows += rows[:2] + [(None, "u", "2024-01-01T00:00:00Z"), ("g", None, "2024-01-01T00:00:00Z"), ("g", "u", None)]
        put(source, f"{k}.json", rows)
        run(spark, source, tmp_path, gate.new_versions)
        for d in sorted({d for d, s, at in rows if d and s and at}):
            at, s = max((at, s) for x, s, at in rows if x == d and s and at)
            if d not in newest or (at, s) > newest[d]:
                if d not in newest or newest[d][1] != s:
                    expected.append((d, s, at))
                newest[d] = (at, s)
    got = spark.read.parquet(f"{tmp_path}/rows").select("key", "version", F.date_format(F.timestamp_micros("at_micros"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    run(spark, source, tmp_path, gate.new_versions)  # nothing new
    assert spark.read.parquet(f"{tmp_path}/rows").count() == len(expected)


def test_first_records_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    of = lambda df: gate.first_records(df, "doc_id", late="2 days")
    seen = lambda: sorted(r.doc_id + r.sha1 for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    put(source, "1.json", [("a", "1", "2024-01-10T00:00:00Z"), ("a", "1", "2024-01-10T00:00:00Z"), ("b", "1", "2024-01-10T00:00:00Z")])
    run(spark, source, tmp_path, of)
    assert seen() == ["a1", "b1"]
    put(source, "2.json", [("a", "2", "2024-01-09T00:00:00Z"), ("b", "2", "2024-01-11T00:00:00Z"), ("c", "2", "2024-01-09T12:00:00Z")])
    run(spark, source, tmp_path, of)
    assert seen() == ["a1", "b1", "c2"]  # repeated within two days; c is late, but not too late
    put(source, "3.json", [("d", "3", "2024-01-20T00:00:00Z")])
    run(spark, source, tmp_path, of)
    put(source, "4.json", [("a", "4", "2024-01-20T00:00:00Z"), ("e", "4", "2024-01-10T00:00:00Z")])
    run(spark, source, tmp_path, of)
    assert seen() == ["a1", "a4", "b1", "c2", "d3"]  # a's state is over; e comes after the watermark
    table = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "1")], "source_url string, sha1 string")
    assert gate.first_records(table).count() == 2
