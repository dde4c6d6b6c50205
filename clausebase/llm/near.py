"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles; equal sets are one class from the
start.  A run draws a tree for each set: every shingle is chosen with
probability 1 / (threshold x size) by a hash that all sets share, so sets that
overlap choose alike; below each chosen shingle the draw is repeated with a new
hash.  Sets that share a path meet in its bucket.  A bucket of at most
``SMALL`` sets is compared by brute force, a larger one is left to its
children, and the last level is compared whatever its size, in square blocks of
a bounded number of sets.  Runs are repeated until the chance of missing a pair
at the threshold is below 1 - ``RECALL``.

In a bucket sets meet as min-hash sketches; what might be similar is joined
into tight groups, each group's sets are then fetched once, and every pair of
a group is verified with its exact Jaccard index.  Links are counted, not
emitted: no step makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable, row_key
from .components import connected_components

WIDTH = 5
SMALL = 64
BLOCK = 512
DEPTH = 3
RECALL = 0.999
SKETCH = 32
#: Distance of the sketch's cut from the threshold, over four standard deviations of its estimate.
SLACK = 0.32
_SKETCH_STEPS = (K.mix(np.arange(1, SKETCH + 1, dtype=K.U)) | K.U(1))[:, None]

_UNIT_COLUMNS = ("unit", "bin", "own", "side_a", "side_b")
_SET_SCHEMA = "unit long, bin int, own int, side_a int, side_b int, id long, copies long, shingles binary"
_BASE_SCHEMA = "rid long, doc_id long, set_hash long, size long, sketch binary, p1 array<long>, p2 array<long>, of2 array<long>, p3 array<long>, of3 array<long>"


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a path of every depth with this probability.

    Shared children of a node are near Poisson with mean 1 or more (1 where one
    set contains the other), so a tree
    of depth d lives with probability p(d) = 1 - exp(-p(d - 1)), p(0) = 1.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - np.exp(-p)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - p)))


def shingle_set(word: np.ndarray) -> np.ndarray:
    return np.unique(K.shingle_hashes(word, WIDTH))


def paths(own: np.ndarray, threshold: float, runs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Path keys of each level, and the parents' keys."""
    limit = K.U(min((1 << 64) - 1, int((1 << 64) / (threshold * len(own)))))
    parents = K.mix(np.arange(1, runs + 1, dtype=K.U) * K.U(0xC2B2AE3D27D4EB4F))
    keys, above = [], []
    for _ in range(DEPTH):
        if len(parents):
            drawn = K.mix(own[None, :] ^ parents[:, None])
            at, token = np.nonzero(drawn <= limit)
            new = K.mix(drawn[at, token] + parents[at] * K.U(31) + K.U(7))
            above.append(parents[at])
        else:
            new = parents
            above.append(parents)
        keys.append(new)
        parents = new
    return keys, above


def _describe(threshold: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("rid")
            for part in K.slices(batch.column("text")):
                word, _, _, bounds = K.words(part)
                out: dict[str, list] = {k: [] for k in ("at", "set_hash", "size", "sketch", "p1", "p2", "of2", "p3", "of3")}
                for k in range(part.last - part.first):
                    own = shingle_set(word[bounds[k] : bounds[k + 1]])
                    if not len(own):
                        continue
                    (p1, p2, p3), (_, of2, of3) = paths(own, threshold, runs)
                    sketch = (K.mix((own[None, :] * _SKETCH_STEPS).min(1)) >> K.U(48)).astype(np.uint16)
                    for name, value in (("at", part.first + k), ("set_hash", int(K.mix(own).sum().view(np.int64))), ("size", len(own)), ("sketch", sketch.tobytes()), ("p1", p1.view(np.int64)), ("p2", p2.view(np.int64)), ("of2", of2.view(np.int64)), ("p3", p3.view(np.int64)), ("of3", of3.view(np.int64))):
                        out[name].append(value)
                longs = {k: pa.array(out[k], pa.list_(pa.int64())) for k in ("p1", "p2", "of2", "p3", "of3")}
                at = pa.array(out["at"], pa.int64())
                yield pa.record_batch({"rid": keys.take(at), "doc_id": ids.take(at), "set_hash": pa.array(out["set_hash"], pa.int64()), "size": pa.array(out["size"], pa.int64()), "sketch": pa.array(out["sketch"], pa.binary())} | longs)

    return run


def blocked(members: DataFrame, sizes: DataFrame, n_rows: int) -> DataFrame:
    """Deals (g, id, ...) into units of at most two blocks of about ``BLOCK`` sets, every pair of a group in exactly one unit.

    sizes: g, n.  Adds unit, side_a, side_b (block numbers of the unit), own
    (the row's block) and bin, which packs units into tasks.
    """
    cut = members.join(sizes, "g").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "g"), F.col("blocks")).cast("int"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = each.withColumn("side_a", F.least("own", "other")).withColumn("side_b", F.greatest("own", "other")).drop("other", "blocks", "n")
    unit = sides.withColumn("unit", F.xxhash64("g", "side_a", "side_b"))
    return unit.withColumn("bin", F.pmod(F.hash("unit"), F.lit(max(16, n_rows // 1500))))


def _units(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    pdf = pdf.sort_values(["unit", "id"], kind="stable")
    cuts = np.flatnonzero(np.diff(pdf["unit"].to_numpy(), prepend=0, append=0) != 0) if len(pdf) > 1 else np.array([0, len(pdf)])
    cuts = np.unique(np.concatenate(([0], cuts, [len(pdf)])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            yield pdf.iloc[a:b]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest index of each node's component; a, b: edges."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _alike(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for part in _units(pdf):
            ids, size = part["id"].to_numpy(), part["size"].to_numpy()
            sketch = np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(len(part), SKETCH)
            own, across = part["own"].to_numpy(), part["side_a"].iloc[0] != part["side_b"].iloc[0]
            a_all, b_all = [], []
            for k in range(len(part) - 1):
                rest = slice(k + 1, None)
                same = (sketch[rest] == sketch[k]).sum(1) >= (threshold - SLACK) * SKETCH
                same &= np.minimum(size[rest], size[k]) >= threshold * np.maximum(size[rest], size[k])
                if across:
                    same &= own[rest] != own[k]
                hit = np.flatnonzero(same) + k + 1
                a_all.append(np.full(len(hit), k))
                b_all.append(hit)
            root = _forest(len(part), np.concatenate(a_all), np.concatenate(b_all))
            moved = np.flatnonzero(root != np.arange(len(part)))
            u.append(ids[moved])
            v.append(ids[root[moved]])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)} if u else {"u": [], "v": []}).astype("int64").drop_duplicates()

    return run


def _verify(threshold: float):
    """Exact: links of each set in its unit, weighted by copies, and a spanning forest of them."""
    top, of = (threshold * 1000).__round__(), 1000

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids_out, links_out, to_out = [], [], []
        for part in _units(pdf):
            ids, copies, own = part["id"].to_numpy(), part["copies"].to_numpy(), part["own"].to_numpy()
            sets = [np.frombuffer(x, np.int64) for x in part["shingles"]]
            across = part["side_a"].iloc[0] != part["side_b"].iloc[0]
            n, size = len(sets), np.array([len(x) for x in sets])
            if n <= 4:
                shared = np.zeros((n, n))
                for i in range(n):
                    for j in range(i + 1, n):
                        shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            else:
                tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
                doc = np.repeat(np.arange(n), size)
                often = np.bincount(at)
                keep = np.flatnonzero(often > 1)  # a token of one set is in no intersection
                place = np.full(len(tokens), -1)
                place[keep] = np.arange(len(keep))
                at = place[at]
                doc, at = doc[at >= 0], at[at >= 0]
                shared = np.zeros((n, n), np.float32)
                order = np.argsort(at, kind="stable")
                doc, at = doc[order], at[order]
                for lo in range(0, len(keep), 8192):
                    x, y = np.searchsorted(at, [lo, lo + 8192])
                    dense = np.zeros((n, min(8192, len(keep) - lo)), np.float32)
                    dense[doc[x:y], at[x:y] - lo] = 1
                    shared += dense @ dense.T
            whole = size[:, None] + size[None, :] - shared
            link = shared * of >= whole * top
            np.fill_diagonal(link, False)
            if across:
                link &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(link))
            root = _forest(n, a, b)
            links = link @ copies
            ids_out.append(ids)
            links_out.append(links)
            to_out.append(ids[root])
        if not ids_out:
            return pd.DataFrame({"id": [], "links": [], "to": []}).astype("int64")
        return pd.DataFrame({"id": np.concatenate(ids_out), "links": np.concatenate(links_out), "to": np.concatenate(to_out)}).astype("int64")

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column("text")):
            word, _, _, bounds = K.words(part)
            sets = [shingle_set(word[bounds[k] : bounds[k + 1]]).tobytes() for k in range(part.last - part.first)]
            rest = batch.slice(part.first, part.last - part.first)
            yield pa.record_batch({k: rest.column(k) for k in (*_UNIT_COLUMNS, "id", "copies")} | {"shingles": pa.array(sets, pa.binary())})


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of documents with an id and words: rid, doc_id, class_id, keeper, n_links for every row; and rid of all rows, doc_id, text.

    keeper is the rid (key of doc_id and text) of the class's row with the
    lowest doc_id, of several such texts the one with the lowest rid.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", row_key())
    base = durable(ids.where("doc_id is not null and text is not null").mapInArrow(_describe(threshold, runs_needed()), _BASE_SCHEMA))
    classes = durable(base.groupBy("set_hash").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("copies")).select("set_hash", F.col("first.rid").alias("id"), F.col("first.doc_id").alias("doc_id"), "copies"))
    reps = base.join(classes.select("set_hash", F.col("id").alias("rid"), "copies"), ["set_hash", "rid"]).dropDuplicates(["set_hash"])
    reps = durable(reps.select(F.col("rid").alias("id"), "set_hash", "size", "sketch", "copies", "p1", "p2", "of2", "p3", "of3"))

    # paths from level to level
    first = reps.select("id", F.explode("p1").alias("g"))
    n1 = first.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    open1 = durable(n1)
    second = reps.select("id", F.explode(F.arrays_zip("p2", "of2")).alias("x")).select("id", F.col("x.p2").alias("g"), F.col("x.of2").alias("up"))
    second = second.join(open1.where(F.col("n") > SMALL).select(F.col("g").alias("up")), "up", "left_semi")
    n2 = durable(second.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    third = reps.select("id", F.explode(F.arrays_zip("p3", "of3")).alias("x")).select("id", F.col("x.p3").alias("g"), F.col("x.of3").alias("up"))
    third = third.join(n2.where(F.col("n") > SMALL).select(F.col("g").alias("up")), "up", "left_semi")
    n3 = durable(third.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    members, sizes = [], []
    for rows, counts, last in ((first, open1, False), (second, n2, False), (third, n3, True)):
        kept = counts if last else counts.where(F.col("n") <= SMALL)
        members.append(rows.select("g", "id").join(kept.select("g"), "g", "left_semi"))
        sizes.append(kept)
    buckets = durable(members[0].unionByName(members[1]).unionByName(members[2]))
    dealt = blocked(buckets, sizes[0].unionByName(sizes[1]).unionByName(sizes[2]), buckets.count())
    edges = dealt.join(reps.select("id", "size", "sketch"), "id").groupBy("bin").applyInPandas(_alike(threshold), "u long, v long")
    groups = durable(connected_components(edges)).select(F.col("component").alias("g"), F.col("node").alias("id"))

    # each group's sets once, verified exactly
    group_sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
    dealt = blocked(groups, group_sizes, groups.count()).join(reps.select("id", "copies"), "id").withColumnRenamed("id", "rid")
    once = ids
    repeated = base.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid")
    if not repeated.isEmpty():  # only such rows are shuffled with their texts
        once = ids.join(repeated, "rid", "left_anti").unionByName(ids.join(repeated, "rid", "left_semi").dropDuplicates(["rid"]))
    texts = once.join(dealt, "rid").select(*_UNIT_COLUMNS, F.col("rid").alias("id"), "copies", "text")
    held = texts.mapInArrow(_sets, _SET_SCHEMA)
    found = durable(held.groupBy("bin").applyInPandas(_verify(threshold), "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("u"), F.col("to").alias("v"))).select(F.col("node").alias("id"), "component")
    joined = durable(classes.join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    firsts = joined.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    result = joined.join(firsts, "component").select("set_hash", F.col("first.doc_id").alias("class_id"), F.col("first.id").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return base.select("rid", "doc_id", "set_hash").join(result, "set_hash").drop("set_hash"), ids


def jaccard_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs.

    class_id is the lowest doc_id of the connected component of links (Jaccard
    index of the shingle sets at or over the threshold), n_links the number of
    other rows linked to this one, copies included.  Words are runs of
    ASCII letters, digits and non-ASCII characters, ASCII lower-cased; a text
    of one to four words has one shingle, all its words.  A text with no words
    (null too) is alone in its class.  Rows that repeat a doc_id with equal
    text are copies of each other, different texts under one doc_id are rows of
    their own, and a null doc_id gets no links.
    """
    linked, ids = _classes(docs, threshold)
    alone = ids.select("rid", "doc_id").join(linked.select("rid").distinct(), "rid", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", "class_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, the one with the lowest doc_id, all its columns as they were; rows without words stay.

    Of rows that repeat one doc_id and text one stays, of several texts under
    the lowest doc_id too; rows with a null doc_id all stay.
    """
    linked, _ = _classes(docs.select("doc_id", "text"), threshold)
    linked = durable(linked)
    gone = linked.where("rid <> keeper").select("rid").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("row", row_key().alias("rid"))
    once = keyed.join(gone, "rid", "left_anti")
    repeated = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(row_key().alias("rid")).groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid")
    if not repeated.isEmpty():  # only such rows are shuffled with their texts
        again = once.join(repeated, "rid", "left_semi").dropDuplicates(["rid"])
        once = once.join(repeated, "rid", "left_anti").unionByName(again)
    return once.select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
l AS (SELECT doc_id, n, i, concat_ws(' ', t, lead(t, 1) OVER k, lead(t, 2) OVER k, lead(t, 3) OVER k, lead(t, 4) OVER k) AS s, lead(t, 4) OVER k AS last FROM u WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM l WHERE last IS NOT NULL OR n < 5 AND i = 1),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 9 * c >= 4 * (x.n + y.n)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
n AS (SELECT a, count(*) AS n_links FROM d GROUP BY a)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(n.n_links), 0) AS n_links FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""
