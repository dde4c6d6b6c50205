"""Removal of long repeated byte strings by a distributed, sparse enhanced suffix array.

A string of ``LENGTH`` bytes that starts in two places holds, in both, the
same *anchor*: the leftmost smallest hash among its ``GRAM``-byte substrings.
So the suffix array is cut into independent buckets: starts of strings are
grouped by their anchor and by the distance to it (in blocks of ``BLOCK``),
keyed by the bytes that all strings of such a group contain.

1. Buckets of one member hold no repeat; they go by their key alone.
2. Members of a bucket whose whole context is equal are one class, and repeats
   of each other.  One of each class goes on.
3. Buckets with several classes get an enhanced suffix array: contexts sorted
   from the shared bytes to the right, the LCP array, and a stack scan that
   yields every LCP interval.  In each interval the left contexts are compared:
   where they differ (left-extension diversity) the interval is a maximal
   repeat with all its occurrences, and each occurrence's longest left match
   within the interval tells which strings of ``LENGTH`` bytes start twice.
4. Buckets of more than ``HOT`` classes are cut into smaller blocks, then into
   single starts, where equal hashes are counted with partial aggregation.

Nothing is capped: step 4 is exact.  Strings are compared by bytes in step 3
and by 64-bit hashes elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable

LENGTH = 400
#: Repeats of PASSAGE bytes or more are found first: they are counted as passages if they hold over PASSAGE_WORDS words, and only texts with any can hold longer ones.
PASSAGE = 280
PASSAGE_WORDS = 50
#: For 400 bytes; in proportion for other lengths.
GRAM = 64
BLOCK = 169
FINE = 21
HOT = 256
#: Bytes of text that a task works on at once; a longer text makes a slice of its own.
SLICE = 1 << 18
#: Rows of one long that may be broadcast to filter texts; beyond, the join shuffles.
FILTER_ROWS = 200_000


def scaled(size: int, length: int) -> int:
    return max(1, size * length // LENGTH)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, K.U)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks_of(sums: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, block: int) -> dict[str, np.ndarray]:
    """Cuts runs of starts [first, last] with one anchor each into blocks of distances to it: key, u, p1, p2, q and the run's index.

    key: hash of what all strings of the block contain, u: of all that the own
    starts cover, q: where the shared bytes begin.
    """
    low, high = (anchor - last) // block, (anchor - first) // block
    n = high - low + 1
    run = np.repeat(np.arange(len(anchor)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[run]
    p1 = np.maximum(first[run], anchor[run] - (b * block + block - 1))
    p2 = np.minimum(last[run], anchor[run] - b * block)
    q = anchor[run] - b * block
    shared = K.span_hash(sums, q, q - (block - 1) + length)
    key = K.mix(shared + b.astype(K.U) * K.U(0x9E3779B97F4A7C15))
    u = K.mix(K.span_hash(sums, p1, p2 + length) + (q - p1).astype(K.U) * K.U(0xC2B2AE3D27D4EB4F))
    return {"key": key, "u": u, "p1": p1, "p2": p2, "q": q, "run": run}


def _anchored(sums: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of starts, and the text it lies in."""
    total = int(ends[-1])
    none = np.zeros(0, np.int64)
    if total < length:
        return none, none, none, none
    bits = K.U(max(20, total.bit_length()))
    at = np.arange(total - gram + 1)
    grams = (sums[gram:] - sums[: total - gram + 1]) * K._power("down", total + 1)[: total - gram + 1]
    smallest = sliding_min((grams * K.U(0xD6E8FEB86659FD93)) >> bits << bits | at.astype(K.U), length - gram + 1)
    anchor = (smallest & ((K.U(1) << bits) - K.U(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, "right") - 1
    good = starts + length <= ends[text + 1]
    starts, anchor, text = starts[good], anchor[good], text[good]
    if not len(starts):
        return none, none, none, none
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    return anchor[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], text[first]


_ITEM = "key long, u long, rid long, p1 long, p2 long, q long"


def _items(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for part in K.slices(batch.column("text"), SLICE):
                sums = K.prefix(part.data)
                anchor, first, last, text = _anchored(sums, part.ends, length, scaled(GRAM, length))
                x = blocks_of(sums, anchor, first, last, length, scaled(BLOCK, length))
                own = text[x["run"]]
                base = part.ends[own]
                yield pa.record_batch({"key": x["key"].view(np.int64), "u": x["u"].view(np.int64), "rid": rid[part.first + own], "p1": x["p1"] - base, "p2": x["p2"] - base, "q": x["q"] - base})

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "u", "m", "ctx", "ql")}
            for text, needs in zip(batch.column("text"), batch.column("needs").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for x in needs:
                    for k in ("key", "u", "m"):
                        out[k].append(x[k])
                    out["ctx"].append(data[x["p1"] : x["p2"] + length])
                    out["ql"].append(x["q"] - x["p1"])
            yield pa.record_batch({"key": pa.array(out["key"], pa.int64()), "u": pa.array(out["u"], pa.int64()), "m": pa.array(out["m"], pa.int64()), "ctx": pa.array(out["ctx"], pa.binary()), "ql": pa.array(out["ql"], pa.int64())})

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(lcp, first, last) of every LCP interval of at least ``least``, children before parents; lcp[i] is between i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack and stack[-1][0] > now:
            value, left = stack.pop()
            if value >= least:
                yield value, left, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, left))


def enhanced_repeats(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, list[int], list[int], bool]]:
    """LCP intervals of suffixes that share their beginning: (right length, members, each one's longest left match, left-diverse).

    rights: from the shared bytes on; lefts: what stands before, reversed.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common(rights[a], rights[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    for value, first, last in lcp_intervals(lcp, least):
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        near = [common(lefts[a], lefts[b]) for a, b in zip(members[:-1], members[1:], strict=True)]
        longest = [max(x, y) for x, y in zip([0, *near], [*near, 0], strict=True)]
        yield value, members, longest, min(near) == 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        pdf = pdf.sort_values("key", kind="stable")
        keys, us, ctxs, qls = (pdf[c].tolist() for c in ("key", "u", "ctx", "ql"))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            ql = qls[a:b]
            rights = [c[q:] for c, q in zip(ctxs[a:b], ql, strict=True)]
            lefts = [c[:q][::-1] for c, q in zip(ctxs[a:b], ql, strict=True)]
            spans: list[list[tuple[int, int]]] = [[] for _ in range(a, b)]
            for right, members, longest, _ in enhanced_repeats(rights, lefts, 1):
                need = max(0, length - right)
                for k, left in zip(members, longest, strict=True):
                    if left >= need:
                        spans[k].append((ql[k] - left, ql[k] - need + length))
            for k, found in enumerate(spans):
                out += [(keys[a + k], us[a + k], s, e) for s, e in merged(found)]
            a = b
        return pd.DataFrame(out, columns=["key", "u", "s", "e"]).astype("int64")

    return run


def _refine(length: int, block: int):
    """Cuts contexts into smaller blocks; at block 1 key and u say the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ctx, key, u, ql in zip(batch.column("ctx"), batch.column("key").to_pylist(), batch.column("u").to_pylist(), batch.column("ql").to_pylist(), strict=True):
                data = np.frombuffer(ctx.as_py(), np.uint8)
                x = blocks_of(K.prefix(data), np.array([ql]), np.array([0]), np.array([len(data) - length]), length, block)
                n = len(x["p1"])
                salt = K.mix(np.array([key], np.int64).view(K.U))
                yield pa.record_batch({"key": pa.array([key] * n, pa.int64()), "u": pa.array([u] * n, pa.int64()), "k2": K.mix(x["key"] + salt).view(np.int64), "u2": K.mix(x["u"] + salt).view(np.int64), "s": x["p1"], "e": x["p2"] + length, "q": x["q"]})

    return run


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, spans: for each text that has any, the byte ranges covered by strings of ``length`` bytes that start elsewhere too.

    docs: rid (long, equal only for equal rows), text.  spans: array of
    struct(s, e), as found, not merged.
    """
    docs = docs.where(f"octet_length(text) >= {length}")
    items = durable(docs.mapInArrow(_items(length), _ITEM))
    shared = durable(items.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))  # cut, so that the join below can split a hot key
    found = durable(items.join(shared, "key"))
    kinds = durable(found.groupBy("key", "u").agg(F.count("*").alias("n"), F.min(F.struct("rid", "p1", "p2", "q")).alias("at")))
    whole = kinds.where("n > 1").select("key", "u", F.lit(0).cast("long").alias("s"), (F.col("at.p2") - F.col("at.p1") + length).alias("e"))
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    open_kinds = kinds.join(several, "key").select("at.rid", F.struct("key", "u", "m", "at.p1", "at.p2", "at.q").alias("x"))
    needs = durable(open_kinds.groupBy("rid").agg(F.collect_list("x").alias("needs")))  # at most the anchors of one text
    texts = docs
    n_needs = needs.count()
    if n_needs <= FILTER_ROWS:
        texts = texts.join(F.broadcast(needs.select("rid")), "rid", "left_semi")
    contexts = durable(texts.join(needs, "rid").mapInArrow(_contexts(length), "key long, u long, m long, ctx binary, ql long"))
    bins = max(16, contexts.count() // 1000)
    cold = contexts.where(F.col("m") <= HOT).withColumn("bin", F.pmod(F.hash("key"), F.lit(bins)))
    spans = cold.groupBy("bin").applyInPandas(_scan(length), "key long, u long, s long, e long")

    # hot buckets: smaller blocks, then single starts
    schema = "key long, u long, k2 long, u2 long, s long, e long, q long"
    hot = contexts.where(F.col("m") > HOT)
    finer = durable(hot.mapInArrow(_refine(length, scaled(FINE, length)), schema))
    own = F.struct("key", "u")
    classes2 = durable(finer.groupBy("k2", "u2").agg(F.min(F.struct("key", "u", "s", "e", "q")).alias("at"), (F.min(own) != F.max(own)).alias("twice")))
    sure = finer.join(classes2.where("twice").select("k2", "u2"), ["k2", "u2"]).select("key", "u", "s", "e")
    unsure = classes2.groupBy("k2").agg(F.count("*").alias("m")).where("m > 1").select("k2")
    # of blocks that stand twice all starts do: one of each class is enough for the others to be compared with
    rest = classes2.join(unsure, "k2").select("at.*").join(hot.select("key", "u", "ctx"), ["key", "u"]).select("key", "u", F.expr("substring(ctx, cast(s + 1 as int), cast(e - s as int))").alias("ctx"), (F.col("q") - F.col("s")).alias("ql"), "s")
    single = rest.mapInArrow(_single(length), "key long, u long, k3 long, s long, e long")
    single = durable(single)
    twice = single.groupBy("k3").agg(F.count_distinct("key", "u").alias("n")).where("n > 1").select("k3")
    last = single.join(twice, "k3").select("key", "u", "s", "e")
    all_spans = whole.unionByName(spans).unionByName(sure).unionByName(last)
    by_kind = durable(all_spans.groupBy("key", "u").agg(F.collect_list(F.struct("s", "e")).alias("spans")))  # at most LENGTH short ones
    placed = found.select("key", "u", "rid", "p1").join(by_kind, ["key", "u"])
    placed = placed.select("rid", F.expr("transform(spans, x -> struct(x.s + p1 as s, x.e + p1 as e))").alias("spans"))
    return placed.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _single(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ctx, key, u, ql, s in zip(batch.column("ctx"), *(batch.column(c).to_pylist() for c in ("key", "u", "ql", "s")), strict=True):
                data = np.frombuffer(ctx.as_py(), np.uint8)
                start = np.arange(len(data) - length + 1)
                salt = K.mix(np.array([key], np.int64).view(K.U))
                k3 = K.mix(K.span_hash(K.prefix(data), start, start + length) + (ql - start).astype(K.U) * K.U(0xC2B2AE3D27D4EB4F) + salt)
                yield pa.record_batch({"key": pa.array([key] * len(start), pa.int64()), "u": pa.array([u] * len(start), pa.int64()), "k3": k3.view(np.int64), "s": start + s, "e": start + s + length})

    return run


def _cut(with_text: bool, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _kept(batch.slice(at, 500), with_text, least_words)

    return run


def _kept(batch: pa.RecordBatch, with_text: bool, least_words: int) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "kept")}
    for text, spans, passages in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("passages").to_pylist(), strict=True):
        data = (text.as_py() or "").encode()
        runs = merged([(x["s"], x["e"]) for x in spans or []])
        edges = [0, *(x for run in runs for x in run), len(data)]
        rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        words = [len(data[a:b].split()) for a, b in merged([(x["s"], x["e"]) for x in passages or []])]
        long_ones = [n for n in words if n > least_words]
        for name, value in (("n_bytes", len(data)), ("n_removed", len(data) - len(rest)), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("n_passages", len(long_ones)), ("n_passage_words", sum(long_ones)), ("kept", rest)):
            out[name].append(value)
    kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items() if with_text or k != "kept"})


def drop_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words and, with_text, kept (the remaining bytes) for every row of docs.

    A null or empty text has 0 bytes.  Rows that repeat each other hold each
    other's strings, so whatever is ``length`` bytes or longer in them goes.
    Matches never cross texts.  n_passages counts the maximal runs covered by
    strings of ``passage`` bytes (at most ``length``) that start elsewhere too
    and that hold over PASSAGE_WORDS words, n_passage_words their words; they
    are not removed for that.
    """
    passage = min(passage, length)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"))
    texts = own.select("rid", "text")
    passages = durable(repeated(texts, passage).withColumnRenamed("spans", "passages"))
    # every string of length bytes that starts twice has one of passage bytes that does
    some = passages.where(F.expr(f"array_max(transform(passages, x -> x.e)) - array_min(transform(passages, x -> x.s)) >= {length}")).select("rid")
    some = F.broadcast(some) if some.count() <= FILTER_ROWS else some
    spans = repeated(texts.join(some, "rid", "left_semi"), length)
    return own.join(passages, "rid", "left").join(spans, "rid", "left").select("doc_id", "text", "spans", "passages").mapInArrow(_cut(with_text, PASSAGE_WORDS), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + ", kept binary" * with_text)
