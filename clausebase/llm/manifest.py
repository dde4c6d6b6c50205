"""Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf.  The leaves of a tree (here: of a language) ascend by
doc_id; two consecutive nodes become their hash, an odd last one the hash of
itself, until one is left, the subroot.  The subroots, in the order of their
trees, become the root in the same way.

Leaves get their places by a range sort: a table of counts for each partition
and tree gives every partition its offset.  Blocks of ``2 ** BLOCK_BITS``
consecutive leaves are then reduced to their roots, each block by itself; if
more than ``TOP_NODES`` roots are left, they are reduced in blocks again.  What
is left is small: the driver builds the top of the trees from it and broadcasts
to each block the path from the block's root to the root.  The executors then
put every row's siblings within its block before that path, and fold.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

BLOCK_BITS = 12
#: Nodes that the driver holds and broadcasts the paths of: about 4 MB.
TOP_NODES = 4096
_PROVED = "doc_id long, tree string, position long, leaf string, claimed string, path array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hash of a row: each value as its UTF-8 length, a colon and the value, a null as a hyphen."""
    each = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in each]), 256)


def tree_key(lang: Column) -> Column:
    """A language as the name of its tree; names sort as languages do, null first, by bytes."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), lang))


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def _height(n: int) -> int:
    return max(0, n - 1).bit_length()


def _sibling(levels: list[list[str]], at: int, level: int) -> str:
    """The other node of a run: ``<`` or ``>`` for its side and its hash; empty if there is none."""
    k = at >> level
    row = levels[level]
    return "" if k ^ 1 >= len(row) else "<>"[k % 2 == 0] + row[k ^ 1]


def top(nodes: list[tuple[str, int, str]]) -> dict[tuple[str, int], tuple[list[str], str, str]]:
    """(tree, position, hash) of all nodes left: each one's path to the root, its subroot, the root."""
    trees: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for tree, at, value in nodes:
        trees[tree].append((at, value))
    names = sorted(trees, key=str.encode)
    built = {t: _reduced([v for _, v in sorted(trees[t])], _height(len(trees[t]))) for t in names}
    over = _reduced([built[t][-1][0] for t in names], _height(len(names)))
    out = {}
    for k, tree in enumerate(names):
        rest = [_sibling(over, k, level) for level in range(len(over) - 1)]
        for at in range(len(built[tree][0])):
            out[tree, at] = [_sibling(built[tree], at, level) for level in range(len(built[tree]) - 1)] + rest, built[tree][-1][0], over[-1][0]
    return out


def placed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tree, leaf, claimed) with n, the leaves of the tree, and pos, the row's place among them, from 0.

    Rows with one doc_id lie by leaf; equal rows in any order, which no hash depends on.
    """
    keys = ["tree", "doc_id", "leaf"]
    kept = durable(rows.withColumn("salt", F.rand(7)))  # a group of equal rows can fall into several ranges
    ranged = kept.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    kept = durable(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = kept.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))  # a row for each partition, and one more for each tree
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n")))
    return kept.join(small(offsets), ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits))


def _levels(table: pa.Table, column: str, bits: int) -> tuple[pa.Table, list[list[str]]]:
    """A block in the order of its nodes, and its levels: as many as blocks have, or up to the root of a tree of one block."""
    table = table.sort_by("pos")
    n = table.column("n")[0].as_py()
    return table, _reduced(table.column(column).to_pylist(), bits if n > 1 << bits else _height(n))


def _block_roots(nodes: DataFrame, column: str, bits: int) -> DataFrame:
    """tree, pos (the block's place), n (blocks of the tree), hash."""

    def root(key: tuple, table: pa.Table) -> pa.Table:
        table, levels = _levels(table, column, bits)
        n = table.column("n")[0].as_py()
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n >> bits)], "hash": [levels[-1][0]]})

    return _in_blocks(nodes.select("tree", "pos", "n", column), bits).groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, hash string")


def _paths(table: pa.Table, column: str, bits: int, above: tuple[list[str], str, str]) -> tuple[pa.Table, dict[str, pa.Array]]:
    """The paths of a block's nodes: siblings in the block, then the path of its root."""
    table, levels = _levels(table, column, bits)
    suffix, subroot, root = above
    flat: list[str] = []
    for at in range(len(table)):
        flat += [_sibling(levels, at, level) for level in range(len(levels) - 1)]
        flat += suffix
    step = len(levels) - 1 + len(suffix)
    path = pa.ListArray.from_arrays(pa.array(range(0, step * len(table) + 1, step) if step else [0] * (len(table) + 1), pa.int32()), pa.array(flat, pa.string()))
    same = lambda x: pa.array([x] * len(table), pa.string())
    return table, {"path": path, "subroot": same(subroot), "root": same(root)}


def _finished(nodes: DataFrame, column: str, kept: list[str], schema: str, bits: int, most: int) -> DataFrame:
    """The kept columns of nodes (tree, pos, n, column), path, subroot and root."""
    roots = durable(_block_roots(nodes, column, bits))
    n = roots.count()
    blocks = _in_blocks(nodes.select(*dict.fromkeys(["tree", "pos", "n", column, *kept])), bits)

    def finish(table: pa.Table, above: tuple[list[str], str, str]) -> pa.Table:
        table, more = _paths(table, column, bits, above)
        return pa.table({c: table.column(c) for c in kept} | more)

    if n <= most:
        paths = nodes.sparkSession.sparkContext.broadcast(top([(r.tree, r.pos, r.hash) for r in roots.collect()]))  # TOP_NODES at most
        return blocks.groupBy("tree", "block").applyInArrow(lambda key, table: finish(table, paths.value[key[0].as_py(), key[1].as_py()]), schema)
    if n == roots.select("tree").distinct().count():
        raise ValueError(f"a manifest has at most {most} trees, these are {n}")
    upper = _finished(roots, "hash", ["tree", "pos"], "tree string, pos long, path array<string>, subroot string, root string", bits, most)

    def joined(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        return finish(table, tuple(above.column(c)[0].as_py() for c in ("path", "subroot", "root")))

    return blocks.groupBy("tree", "block").cogroup(upper.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(joined, schema)


def prove(rows: DataFrame, bits: int = BLOCK_BITS, most: int = TOP_NODES) -> DataFrame:
    """doc_id, tree, position, leaf, claimed, path, subroot, root for each of rows (doc_id, tree, leaf, claimed); other columns are left out.

    path lists, from the leaf to the root, the other node of each run: its hash
    after ``<`` or ``>``, the side on which it stands; an empty string where a
    node is alone.  A null doc_id comes first in its tree.  There are at most
    ``most`` trees.  Repeated rows are leaves of their own; no rows give none.
    """
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "tree", "leaf", "claimed")
    nodes = placed(own).withColumn("position", F.col("pos"))
    kept = ["doc_id", "tree", "position", "leaf", "claimed"]
    return _finished(nodes, "leaf", kept, _PROVED, bits, most)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, start, lambda x, s: F.sha2(F.when(F.startswith(s, F.lit("<")), F.concat(other(s), x)).otherwise(F.concat(x, other(s))), 256))


def tampered(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf of each document, and claimed: where 7 divides the checksum of doc_id the leaf of the row with one more in n_chars (a null stays), else null."""
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = (F.crc32(c["doc_id"].cast("string")) % 7 == 0) & c["n_chars"].isNotNull()
    return docs.select(c["doc_id"].cast("long").alias("doc_id"), tree_key(c["lang"]).alias("tree"), leaf(**c).alias("leaf"), F.when(hit, leaf(**c | {"n_chars": c["n_chars"] + 1})).alias("claimed"))


def verified(docs: DataFrame, bits: int = BLOCK_BITS, most: int = TOP_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document's proof, and the root that its tampered row leads to.

    A null doc_id has no checksum and is not tampered with.
    """
    found = prove(tampered(docs), bits, most)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)), 4294967295) END AS crc FROM documents, tab),
f AS (SELECT *, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS other FROM d),
p AS (SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(octet_length(encode(other::VARCHAR)) || ':' || other, '-') AS o, coalesce(octet_length(encode(text)) || ':' || text, '-') AS body FROM f),
l AS (SELECT doc_id, coalesce(':' || lang, '-') AS tree, sha256(head || n || body) AS leaf, sha256(head || o || body) AS claimed FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
low AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM k
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
sub AS (SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS trees FROM low WHERE n = 1),
up AS (SELECT 0 AS level, rank AS pos, subroot AS h, trees AS n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT k.tree, k.pos, low.level AS step, low.pos AS other, low.h FROM k JOIN low ON low.tree = k.tree AND low.n > 1 AND low.pos // 2 = k.pos // (1 << (low.level + 1))
  UNION ALL SELECT k.tree, k.pos, sub.height + up.level, up.pos + 1000000000, up.h FROM k JOIN sub ON sub.tree = k.tree JOIN up ON up.n > 1 AND up.pos // 2 = sub.rank // (1 << (up.level + 1))),
own AS (SELECT s.tree, s.pos, s.step, s.other, s.h, CASE WHEN s.other >= 1000000000 THEN s.other - 1000000000 = sub.rank // (1 << (s.step - sub.height)) ELSE s.other = s.pos // (1 << s.step) END AS mine FROM steps s JOIN sub ON sub.tree = s.tree),
runs AS (SELECT tree, pos, step, coalesce(string_agg(CASE WHEN NOT mine THEN h END, '' ORDER BY other), '') AS sib, coalesce(bool_and(CASE WHEN NOT mine THEN other % 2 = 0 END), false) AS before FROM own GROUP BY tree, pos, step),
proofs AS (SELECT tree, pos, string_agg(sib, '' ORDER BY step) AS proof, list(sib ORDER BY step) AS sibs, list(before ORDER BY step) AS sides FROM runs GROUP BY tree, pos),
fold AS (SELECT k.tree, k.pos, 0 AS step, claimed AS h FROM k
  UNION ALL SELECT fold.tree, fold.pos, fold.step + 1, sha256(CASE WHEN r.before THEN r.sib || fold.h ELSE fold.h || r.sib END) FROM fold JOIN runs r ON r.tree = fold.tree AND r.pos = fold.pos AND r.step = fold.step)
SELECT k.doc_id, k.leaf, sub.subroot, (SELECT h FROM up WHERE n = 1) AS root, sha256(coalesce(proofs.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = (SELECT h FROM up WHERE n = 1) AS verified
FROM k JOIN sub ON sub.tree = k.tree LEFT JOIN proofs ON proofs.tree = k.tree AND proofs.pos = k.pos
JOIN (SELECT tree, pos, arg_max(h, step) AS h FROM fold GROUP BY tree, pos) e ON e.tree = k.tree AND e.pos = k.pos
"""
