"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text's lines are its paragraphs; a paragraph's leaves are pieces of at most
64 characters that start anew after full stops.  A section ends after a
paragraph whose hash says so (about one in eight), so an inserted paragraph
moves no other boundary.  Inner nodes hash their children; equal roots mean
equal texts.  The fingerprint string is the root, a colon, and 8 hex digits of
each leaf with ``.`` after a paragraph and ``/`` after a section, so branches
that differ locate an edit and the share of common leaves is a likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

PIECE = r"[^.]{1,64}\.*|\.+"
BUCKET = 1000
MOST_BUCKETS = 4096


def tree(text: Column) -> Column:
    """Leaf hashes by paragraph: array<array<string>>."""
    return F.transform(F.split(text, "\n"), lambda line: F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: F.md5(p.cast("binary"))))


def root(leaves: Column) -> Column:
    paragraphs = F.transform(leaves, lambda own: F.md5(F.array_join(own, "").cast("binary")))
    marked = F.array_join(F.transform(paragraphs, lambda p: F.when(p < "2", F.concat(p, F.lit("/"))).otherwise(p)), "")
    sections = F.transform(F.split(marked, "/"), lambda s: F.md5(s.cast("binary")))
    return F.sha2(F.array_join(sections, "").cast("binary"), 256)


def sketch(leaves: Column) -> Column:
    return F.array_join(F.transform(leaves, lambda own: F.concat(F.array_join(F.transform(own, lambda h: F.substring(h, 1, 8)), ""), F.when(F.md5(F.array_join(own, "").cast("binary")) < "2", "/").otherwise("."))), "")


def fingerprint(leaves: Column) -> Column:
    return F.concat(root(leaves), F.lit(":"), sketch(leaves))


def short_leaves(leaves: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(leaves), lambda h: F.substring(h, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Common leaves over the larger number of leaves, from the distinct short leaves of two fingerprints; 1 for two empty texts."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def changed_paragraphs(one: Column, other: Column) -> Column:
    """Numbers (from 0) of the paragraphs of fingerprint ``one`` whose branch is nowhere in ``other``."""
    a, b = (F.split(F.rtrim(F.translate(F.element_at(F.split(x, ":"), 2), "/", "."), F.lit(".")), r"\.") for x in (one, other))
    numbered = F.transform(a, lambda p, i: F.when(~F.array_contains(b, p), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, root, fingerprint of every row (null text: empty)."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("leaves", tree(F.col("text")))
    return own.select("doc_id", "text", root(F.col("leaves")).alias("root"), fingerprint(F.col("leaves")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id, of the first for the last.

    Ids are cut into buckets at approximate quantiles, each about ``BUCKET``
    rows, and only rows of a bucket are sorted; a bucket's last row takes the
    first of the next bucket that has any.  Rows that share an id are ordered
    by text.  One row alone is its own next.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = own.count()
    n_buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET)))
    cuts = []
    if n_buckets > 1:
        cuts = sorted(set(own.agg(F.percentile_approx("doc_id", [i / n_buckets for i in range(1, n_buckets)], 10 * n_buckets).alias("c")).first()["c"]))
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    if cuts:
        coarse, fine = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>"), F.from_json(F.lit(str(groups)), "array<array<bigint>>")
        group = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * 64 + F.size(F.filter(F.get(fine, group - 1), lambda c: c <= F.col("doc_id"))))
    else:
        bucket = F.lit(0)
    dealt = own.withColumn("bucket", bucket.cast("int"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ranked = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("is_first", F.lag(F.lit(1)).over(order).isNull())
    firsts = ranked.where("is_first").select("bucket", F.col("text").alias("first_text"))
    held = durable(firsts.select("bucket").distinct())
    low = held.agg(F.min("bucket").alias("low")).first()["low"]
    follow = held.select("bucket", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.lit(low)).alias("after"))  # MOST_BUCKETS rows
    border = follow.join(firsts.withColumnRenamed("bucket", "after"), "after").select("bucket", "first_text")
    return ranked.join(border, "bucket").select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The query's columns: each text against its edited form and the next document.

    Empty texts have the fingerprint of the empty tree; a text of fewer than
    four characters is its own edited form.
    """
    own = with_next(docs)
    own = own.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.expr("left(next_text, cast(n_chars div 4 as int))")))
    own = own.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))
    own = own.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), short_leaves(F.col("a")).alias("sa"), short_leaves(F.col("b")).alias("sb"), short_leaves(F.col("c")).alias("sc"))
    return own.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("sa"), F.col("sb")).alias("near_edited"), likeness(F.col("sa"), F.col("sc")).alias("near_next"))


def _sql_tree(text: str) -> str:
    return rf"list_transform(string_split({text}, chr(10)), lambda l: list_transform(regexp_extract_all(l, '[^.]{{1,64}}\.*|\.+'), lambda p: md5(p)))"


def _sql_print(tree: str) -> str:
    marked = f"array_to_string(list_transform({tree}, lambda o: CASE WHEN md5(coalesce(array_to_string(o, ''), '')) < '2' THEN md5(coalesce(array_to_string(o, ''), '')) || '/' ELSE md5(coalesce(array_to_string(o, ''), '')) END), '')"
    leaves = f"array_to_string(list_transform({tree}, lambda o: coalesce(array_to_string(list_transform(o, lambda h: substr(h, 1, 8)), ''), '') || CASE WHEN md5(coalesce(array_to_string(o, ''), '')) < '2' THEN '/' ELSE '.' END), '')"
    return f"sha256(array_to_string(list_transform(string_split({marked}, '/'), lambda s: md5(s)), '')) || ':' || {leaves}"


def _sql_like(a: str, b: str) -> str:
    return f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0::DOUBLE ELSE len(list_distinct(list_intersect({a}, {b})))::DOUBLE / greatest(len({a}), len({b})) END"


ORACLE_SQL = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nx AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM o),
ed AS (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM nx),
tr AS (SELECT *, {_sql_tree("text")} AS a, {_sql_tree("edited")} AS b, {_sql_tree("next_text")} AS c FROM ed),
sh AS (SELECT *, {", ".join(f"list_distinct(list_transform(flatten({x}), lambda h: substr(h, 1, 8))) AS s{x}" for x in "abc")} FROM tr)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_print("a")} AS fingerprint, {_sql_print("b")} AS edited_fingerprint, {_sql_like("sa", "sb")} AS near_edited, {_sql_like("sa", "sc")} AS near_next
FROM sh
"""
