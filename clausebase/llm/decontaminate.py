"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are dealt into classes by size (powers of two of their distinct
five-word shingles).  An item's sketch is the bottom k of its shingle hashes.
A document that contains a share ``threshold`` of an item's shingles misses at
most floor((1 - threshold) n) of them, so with k one more than that for the
largest n of the class, it holds at least one of the k minima: looking the
minima up in a document's hashes misses no item.  Hits are verified by exact
containment of the shingles.

Everything about a document is decided in its own row, inside one scan: no
shuffle, whatever the number of copies of a passage.  Items come in blocks of
``BLOCK`` as literals of the plan; more than ``LITERAL_BLOCKS`` of them are
joined instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fence, small

WIDTH = 5
BLOCK = 512
LITERAL_BLOCKS = 4
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(words: Column) -> Column:
    """Hashes of five words in a row; an empty array for fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - WIDTH)
    each = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))
    return F.when(F.size(words) >= WIDTH, each).otherwise(F.array().cast("array<bigint>"))


def items_of(benchmark: DataFrame, per_mille: int) -> DataFrame:
    """item_id, n, least (shared shingles needed), size class, minima, shingles; an id that is repeated is one item with all its shingles."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), fence(word_list(F.col("text"))).alias("w")).select("item_id", shingles(F.col("w")).alias("s"))
    own = own.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("shingles"))
    own = own.withColumn("n", F.size("shingles")).where("n > 0 and item_id is not null")
    own = own.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    # for the largest n of the class
    k = F.expr(f"cast(shiftleft(1, size_class + 1) - 1 - ceil((shiftleft(1, size_class + 1) - 1) * {per_mille} / 1000.0) + 1 as int)")
    return own.select("item_id", "n", F.expr(f"cast(ceil(n * {per_mille} / 1000.0) as int)").alias("least"), "size_class", F.slice("shingles", 1, k).alias("minima"), "shingles")


def _literal(rows: list) -> Column:
    schema = "array<struct<item_id: bigint, n: int, least: int, minima: array<bigint>, shingles: array<bigint>>>"
    return F.from_json(F.lit(json.dumps([{k: row[k] for k in ("item_id", "n", "least", "minima", "shingles")} for row in rows])), schema)


def _in_row(rows: list) -> tuple[Column, Column]:
    """The minima of one block of items that a document holds, and its hits."""
    minima = sorted({m for row in rows for m in row["minima"]})
    some = F.array_intersect("own_shingles", F.from_json(F.lit(json.dumps(minima)), "array<bigint>"))
    near = F.filter(_literal(rows), lambda it: (F.size("own_shingles") >= it["least"]) & F.arrays_overlap(it["minima"], F.col("own_minima")))
    exact = F.transform(near, lambda it: F.struct(it["item_id"].alias("item_id"), it["n"].alias("n"), it["least"].alias("least"), F.size(F.array_intersect(it["shingles"], F.col("own_shingles"))).alias("shared")))
    return some, F.when(F.size("own_minima") > 0, F.filter(exact, lambda h: h["shared"] >= h["least"])).otherwise(F.array().cast("array<struct<item_id:bigint,n:int,least:int,shared:int>>"))


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with a column benchmark_hits: array of struct(item_id, n, least, shared), for at most LITERAL_BLOCKS blocks of items."""
    rows = items_of(benchmark, round(threshold * 1000)).orderBy("size_class", "item_id").limit(BLOCK * LITERAL_BLOCKS + 1).collect()
    if len(rows) > BLOCK * LITERAL_BLOCKS:
        raise ValueError("too many items for literals")
    names = docs.columns
    held = docs.select(*[F.col(c) for c in names], F.array().cast("array<struct<item_id:bigint,n:int,least:int,shared:int>>").alias("benchmark_hits"), fence(word_list(F.col("text"))).alias("own_words"))
    held = held.select(*names, "benchmark_hits", fence(shingles(F.col("own_words"))).alias("own_shingles"))
    for i in range(0, len(rows), BLOCK):
        some, hits = _in_row(rows[i : i + BLOCK])
        held = held.withColumn("own_minima", fence(some)).withColumn("benchmark_hits", fence(F.concat("benchmark_hits", hits))).drop("own_minima")
    return held.select(*names, "benchmark_hits")


def _row() -> Column:
    """A key of rows equal in doc_id and text, null apart from any value."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _joined(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The same for any number of items, by joins: row (from ``_row``), doc_id, item_id, n, shared, once for rows that repeat each other."""
    items = items_of(benchmark, round(threshold * 1000))
    own = docs.select(_row().alias("row"), "doc_id", fence(word_list(F.col("text"))).alias("w")).select("row", "doc_id", fence(F.array_distinct(shingles(F.col("w")))).alias("s")).select("row", "doc_id", F.explode("s").alias("h"))
    minima, whole = items.select("item_id", F.explode("minima").alias("h")), items.select("item_id", "n", "least", F.explode("shingles").alias("h"))
    near = own.join(small(minima), "h").select("row", "item_id").distinct()
    shared = own.join(small(whole), "h").groupBy("row", "doc_id", "item_id", "n", "least").agg(F.count_distinct("h").cast("int").alias("shared"))  # repeated rows hold each shingle once
    return shared.join(near, ["row", "item_id"], "left_semi").where("shared >= least").select("row", "doc_id", "item_id", "n", "shared")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for each item a document contains to the threshold.

    Words are lower-cased runs of letters and digits.  Items of fewer than
    five words have no shingle and are in no document; null or short texts
    contain none.  Each row is judged alone, whether its doc_id is null or
    another's too; repeated rows repeat their hits.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if benchmark.count() > BLOCK * LITERAL_BLOCKS:
        found = own.select(_row().alias("row")).join(_joined(own, benchmark, threshold), "row")
    else:
        found = with_hits(own, benchmark, threshold).select("doc_id", F.explode("benchmark_hits").alias("h")).select("doc_id", "h.item_id", "h.n", "h.shared")
    return found.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("shared").cast("long").alias("n_shared"), (F.col("shared") / F.col("n")).alias("containment"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, all columns as they were, whatever their names."""
    own = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    if benchmark.count() > BLOCK * LITERAL_BLOCKS:
        gone = _joined(docs.select("doc_id", "text"), benchmark, threshold).select(F.col("row").alias("key")).distinct()
        return own.select("row", _row().alias("key")).join(gone, "key", "left_anti").select("row.*")
    return with_hits(own.select("row", "text"), benchmark, threshold).where(F.size("benchmark_hits") == 0).select("row.*")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
du AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM dw),
bu AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM bw),
dl AS (SELECT doc_id, concat_ws(' ', t, lead(t, 1) OVER k, lead(t, 2) OVER k, lead(t, 3) OVER k, lead(t, 4) OVER k) AS s, lead(t, 4) OVER k AS last FROM du WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
bl AS (SELECT item_id, concat_ws(' ', t, lead(t, 1) OVER k, lead(t, 2) OVER k, lead(t, 3) OVER k, lead(t, 4) OVER k) AS s, lead(t, 4) OVER k AS last FROM bu WINDOW k AS (PARTITION BY item_id ORDER BY i)),
ds AS (SELECT DISTINCT doc_id, s FROM dl WHERE last IS NOT NULL),
bs AS (SELECT DISTINCT item_id, s FROM bl WHERE last IS NOT NULL),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n AS containment
FROM hit JOIN n USING (item_id) WHERE shared >= ceil(n * 800 / 1000.0)
"""
