"""Quality selection by importance resampling.

Two generative models over hashed unigrams and bigrams: one of the target
(documents labelled good and not toxic), one of all raw text.  A document's
log weight is the log ratio of the two models over its n-grams; adding seeded
Gumbel noise and keeping the k largest draws k documents without replacement
in proportion to the weights.

The raw model counts every document.  The target model is fitted on labelled
rows, at most ``TARGET_ROWS`` of them (lowest hash of the id first).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS = 18
BINS = 1 << BITS
TARGET_ROWS = 20_000
CELLS = 4096
#: Rows of a border cell that one task may rank.
EDGE_ROWS = 100_000


def features(part: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the unigrams and bigrams of a slice, text by text, and each text's bounds among them.

    Tokens are ASCII-lower-cased runs between white space, so that marks and
    junk characters count as evidence, besides the bare words in them.
    """
    low = K.LOWER[part.data]
    sums = K.prefix(low)
    starts, stops, bounds = K.runs(~K.SPACE[low], part.ends)
    token = K.span_hash(sums, starts, stops)
    w_starts, w_stops, w_bounds = K.runs(K.WORD[low], part.ends)
    word = K.span_hash(sums, w_starts, w_stops)
    pair = np.zeros(len(word), K.U)
    pair[1:] = K.mix(word[:-1] * K.U(0x9FB21C651E98DF25) + word[1:])
    n_docs = part.last - part.first
    doc_t, doc_w = np.repeat(np.arange(n_docs), np.diff(bounds)), np.repeat(np.arange(n_docs), np.diff(w_bounds))
    inner = np.ones(len(word), bool)
    inner[w_bounds[:-1][w_bounds[:-1] < len(word)]] = False
    doc = np.concatenate((doc_t, doc_w, doc_w[inner]))
    bins = np.concatenate((token >> K.U(64 - BITS), (word ^ K.U(1 << 50)) >> K.U(64 - BITS), pair[inner] >> K.U(64 - BITS))).astype(np.int64)
    order = np.argsort(doc, kind="stable")
    return bins[order], np.searchsorted(doc[order], np.arange(n_docs + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        good = np.array(batch.column("is_target").to_pylist(), bool)
        for part in K.slices(batch.column("text")):
            bins, bounds = features(part)
            raw += np.bincount(bins, minlength=BINS)
            mask = np.repeat(good[part.first : part.last], np.diff(bounds))
            if mask.any():
                target += np.bincount(bins[mask], minlength=BINS)
    at = np.flatnonzero(raw)
    yield pa.record_batch({"bin": pa.array(at, pa.int64()), "raw": pa.array(raw[at]), "target": pa.array(target[at])})


def learn(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Log ratio target / raw of each bin. target_ids: a column doc_id, at most ``TARGET_ROWS`` rows."""
    marked = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id", F.lit(True).alias("is_target"))), "doc_id", "left")
    rows = marked.select("text", F.coalesce("is_target", F.lit(False)).alias("is_target")).mapInArrow(_count, "bin long, raw long, target long")
    raw, target = np.zeros(BINS), np.zeros(BINS)
    for row in rows.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BINS rows at most
        raw[row["bin"]], target[row["bin"]] = row["raw"], row["target"]
    share = max(target.sum(), 1) / max(raw.sum(), 1)
    raw_p, target_p = raw + 1 / share, target + 1
    return np.log(target_p / target_p.sum()) - np.log(raw_p / raw_p.sum())


def _gumbel(doc_id: np.ndarray, seed: int) -> np.ndarray:
    bits = K.mix(K.mix(doc_id.astype(np.int64).view(K.U) + K.U(seed)) ^ K.U(0xA5A5A5A5))
    return -np.log(-np.log(((bits >> K.U(11)).astype(np.float64) + 0.5) / (1 << 53)))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 1) -> DataFrame:
    """doc_id, log_weight (sum over the document's n-grams), mean_weight (by n-gram), gumbel.

    A null or empty text has no evidence: weight minus infinity is avoided, it
    gets the lowest finite weight of -1e9.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for part in K.slices(batch.column("text")):
                bins, bounds = features(part)
                doc = np.repeat(np.arange(part.last - part.first), np.diff(bounds))
                total[part.first : part.last] = np.bincount(doc, ratio[bins], part.last - part.first)
                n[part.first : part.last] = np.diff(bounds)
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            total = np.where(n > 0, total, -1e9)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "log_weight": pa.array(total), "mean_weight": pa.array(total / np.maximum(n, 1)), "gumbel": pa.array(_gumbel(ids, seed))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double, mean_weight double, gumbel double")


def top_k(scored: DataFrame, key: str, k: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The k rows with the largest key, ties by the lower doc_id (null last); no task ranks more than ``edge_rows`` rows.

    An approximate percentile table cuts the keys into cells; whole cells
    above the border are taken, and only the border cell is ranked.  A border
    cell of more than ``edge_rows`` is cut again, one of equal keys by doc_id.
    Of rows with equal key and doc_id any are taken.  Only ids above 2^53 that
    a double can't tell apart are ranked in one task whatever their number.
    """
    ties = scored.withColumn("tie_of_key", F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(2**63))))
    return _largest(ties, [key, "tie_of_key"], k, edge_rows).drop("tie_of_key")


def _largest(rows: DataFrame, keys: list[str], k: int, edge_rows: int) -> DataFrame:
    n = rows.count()
    if k >= n:
        return rows
    if k <= 0 or not keys:
        return rows.limit(max(k, 0))
    key = keys[0]
    cuts = rows.agg(F.percentile_approx(key, [i / CELLS for i in range(1, CELLS)], 4 * CELLS).alias("c")).first()["c"]
    cuts = sorted(set(cuts))
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    kind = rows.schema[key].dataType.simpleString()
    # JSON of a literal is folded once; a transform of one would be evaluated for each row
    coarse, fine = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{kind}>"), F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    group = F.size(F.filter(coarse, lambda c: c <= F.col(key)))
    cell = F.when(group == 0, 0).otherwise((group - 1) * 64 + F.size(F.filter(F.element_at(fine, group), lambda c: c <= F.col(key))))
    held = rows.withColumn("cell_of_key", cell.cast("int"))
    sizes = {r["cell_of_key"]: r["count"] for r in held.groupBy("cell_of_key").count().collect()}  # CELLS rows at most
    left, border = k, -1
    for c in sorted(sizes, reverse=True):
        if sizes[c] > left:
            border = c
            break
        left -= sizes[c]
    above = held.where(F.col("cell_of_key") > border).drop("cell_of_key")
    edge = held.where(F.col("cell_of_key") == border).drop("cell_of_key")
    if left == 0:
        return above
    ranked = edge.orderBy(*[F.col(c).desc() for c in keys]).limit(left)
    if sizes[border] <= edge_rows:
        return above.unionByName(ranked)
    if sizes[border] < n:
        return above.unionByName(_largest(edge, keys, left, edge_rows))
    # a single cell: its one cut is the lowest key, and nearly all rows have it
    more, same = rows.where(F.col(key) > F.lit(cuts[0])), rows.where(F.col(key) <= F.lit(cuts[0]))
    n_more = more.count()
    if n_more == n:
        return ranked
    if n_more >= left:
        return _largest(more, keys, left, edge_rows)
    return more.unionByName(_largest(same, keys[1:], left - n_more, edge_rows))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, share: float | None = None) -> DataFrame:
    """The documents drawn, with log_weight, mean_weight and key: k = round(share x documents).

    share: by default the share of labelled documents that are good and not
    toxic.  With no label at all every document is kept with its noise.
    """
    from .common import durable

    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    good = marks.where("quality = 1 and toxic = 0")
    if share is None:
        n, n_good = marks.count(), good.count()
        share = n_good / n if n else 1.0
    target = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    ratio = learn(docs, target)
    scored = durable(weigh(docs, ratio, seed).withColumn("key", F.col("log_weight") + F.col("gumbel")))
    return top_k(scored, "key", round(share * scored.count())).drop("gumbel")


