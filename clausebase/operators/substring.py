"""Which texts contain which needles, keyed on the needles' rarest words instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fence
from .crawl import cut

WORD = r"[\p{L}\p{N}]+"
GRAM = 3
#: Rows up to which the needles' side of a join is broadcast, after a count; needles of a block that are compared with every text.
BROADCAST_ROWS, BLOCK = 20_000, 500


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, none if there are fewer. words: hashes of the words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def containing(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """item_id, doc_id of each of docs (doc_id, text) whose text contains a needle of needles (item_id, needle), whatever the case.

    The words within a needle, but for its first and last, stand whole in any
    text that contains it.  A needle is looked up by that run of up to three of
    them that is in the fewest texts, and found texts are searched for it.
    Needles without such a word are compared with every text, a block of them
    at a time.  Null and empty needles are in no text; a pair of ids appears
    once.
    """
    low = needles.where("item_id is not null and coalesce(needle, '') <> ''").select("item_id", F.lower("needle").alias("needle"))
    words = low.select("item_id", "needle", F.regexp_extract_all("needle", F.lit(WORD), F.lit(0)).alias("w")).withColumn("inner", fence(F.when(F.size("w") > 2, F.slice("w", 2, F.size("w") - 2)).otherwise(F.array().cast("array<string>"))))
    keyed = words.where(F.size("inner") > 0).withColumn("n", F.least(F.lit(GRAM), F.size("inner")))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # GRAM at most
    texts = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null")
    found = _of_short(texts, words.where(F.size("inner") == 0))
    if not sizes:
        return found.distinct()
    of_size = lambda w: F.coalesce(*[F.when(F.col("n") == n, _grams(w, n)) for n in sizes])
    grams = keyed.select("item_id", F.explode(F.array_distinct(of_size(fence(_hashes(F.col("inner")))))).alias("h"))
    own = texts.select("doc_id", fence(_hashes(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*[_grams(F.col("w"), n) for n in sizes]))).alias("h"))
    hits = cut(own.join(small(grams.select("h").distinct()), "h"))  # the texts' words are read once
    counts = hits.groupBy("h").agg(F.count("*").alias("c"))
    # a needle with a run that no text has is in none
    picked = grams.join(counts, "h", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h")).alias("best")).where("best.c > 0").select("item_id", F.col("best.h").alias("h"))
    pairs = cut(hits.join(small(picked), "h").select("item_id", "doc_id").distinct())
    checked = texts.join(small(pairs), "doc_id").join(small(low), "item_id").where(F.contains("text", "needle")).select("item_id", "doc_id")
    return cut(checked.unionByName(found).distinct())


def _of_short(texts: DataFrame, needles: DataFrame) -> DataFrame:
    out, block = None, []

    def compared(block: list[tuple]) -> DataFrame:
        held = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(n).alias("needle")) for i, n in block])
        return texts.select(F.explode(F.filter(held, lambda x: F.contains(F.col("text"), x["needle"]))).alias("x"), "doc_id").select("x.item_id", "doc_id")

    for row in needles.select("item_id", "needle").toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK:
            out, block = compared(block) if out is None else out.unionByName(compared(block)), []
    if block:
        out = compared(block) if out is None else out.unionByName(compared(block))
    return texts.select(F.lit(None).cast(needles.schema["item_id"].dataType).alias("item_id"), "doc_id").where(F.lit(False)) if out is None else out
