"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source).  At each node it
is shared among the children by their weights; a child that cannot use its
share, even when all it holds is read ``max_epochs`` times, is filled up and
what is left goes to its siblings, and only when all of them are full does the
shortage reach the node itself, and so the node's own siblings.  This is water
filling with capacities summed from below, done with one window per level over
the node table.

A leaf's budget is whole epochs plus the token prefix of the next epoch: each
epoch orders the leaf's documents anew by a seeded hash.  The prefix is found in
buckets of about ``BUCKET`` documents, so that only one bucket of a leaf is
ever sorted, however large the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

BUCKET = 1024
LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Production parameters of the query; weights are whole numbers, 1 where none is given.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "es": 2, "fr": 2}, "source": {"src0": 3}}
BUDGET_SHARE = 0.5
MAX_EPOCHS = 3
SEED = 17


def default_domain() -> Column:
    """Documents carry no domain: sources are dealt into four."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce("source", F.lit(NONE)).cast("binary")) % 4).cast("string"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(None).cast("long")
    for value, weight in known.items():
        out = F.when(F.col(level) == value, F.lit(int(weight)).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(1).cast("long"))


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens, n_docs) with the column budget: tokens for each leaf.

    The sum is the budget or, if less, all capacity.  Shares are rounded so
    that the rounded shares of siblings add up.
    """
    capacity = F.sum(F.col("tokens") * max_epochs)
    parent = leaves.agg(F.least(F.lit(int(budget)), F.coalesce(capacity, F.lit(0))).cast("long").alias("budget"))
    for depth in range(1, len(levels) + 1):
        above, own = list(levels[: depth - 1]), list(levels[:depth])
        nodes = leaves.groupBy(*own).agg(capacity.cast("long").alias("cap")).withColumn("w", _weight(own[-1], weights))
        nodes = nodes.join(parent, above) if above else nodes.join(F.broadcast(parent))  # one row
        order = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), own[-1]) if above else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), own[-1])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        nodes = nodes.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0)))
        nodes = nodes.withColumn("level", (F.col("budget") - F.col("c0")).cast("double") / (F.sum("w").over(group) - F.col("w0")).cast("double"))
        nodes = nodes.withColumn("full", F.col("cap").cast("double") <= F.col("level") * F.col("w").cast("double"))
        nodes = nodes.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(group)).withColumn("w1", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(group))
        upto = (F.col("w0") + F.col("w") - F.col("w1")).cast("double") * F.col("water")
        start = (F.col("w0") - F.col("w1")).cast("double") * F.col("water")
        share = F.floor(upto + F.lit(1e-6)) - F.floor(start + F.lit(1e-6))
        nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)).cast("long"))
        parent = nodes.select(*own, "budget")
    return leaves.join(parent, list(levels))


def mix_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, full_epochs, tokens_taken, for the documents of which any token is taken.

    Tokens are runs without white space.  tokens_taken counts over all epochs;
    the document at the end of the prefix gives its first tokens only.  A null
    level is the node ``(none)``.  Texts without tokens are never taken.
    Repeated rows are documents of their own with equal places in the order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain if domain is not None else default_domain(), F.lit(NONE)).alias("domain"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")
    rows = durable(rows)
    levels = list(LEVELS)
    leaves = durable(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")))
    total, n_leaves = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    plan = budgets(leaves, LEVELS, weights, int(total * budget_share), max_epochs)
    plan = plan.select(*levels, F.expr("budget div tokens").alias("full_epochs"), F.expr("budget % tokens").alias("rest"), F.ceil(F.col("n_docs") / BUCKET).cast("long").alias("n_buckets"))
    plan = durable(plan)
    own = rows.join(small(plan, n_leaves), levels)
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).cast("binary")), 1, 15), 16, 10).cast("long")
    own = own.withColumn("place", place).withColumn("bucket", F.expr("((place div 268435456) * n_buckets) div 4294967296"))
    key = [*levels, "bucket"]
    sums = own.groupBy(*key).agg(F.sum("n_tokens").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy(*levels).orderBy("bucket")) - F.col("in_bucket"))
    held = own.join(sums, key)
    inner = held.withColumn("part", F.when(F.col("before") + F.col("in_bucket") <= F.col("rest"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    border = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest"))
    run = Window.partitionBy(*key).orderBy("place", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = held.where(border).withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))).cast("long"))
    both = inner.where(~border).unionByName(edge)
    return both.withColumn("tokens_taken", F.col("full_epochs") * F.col("n_tokens") + F.col("part")).where("tokens_taken > 0").select("doc_id", *levels, "n_tokens", "full_epochs", "tokens_taken")


def oracle_sql(weights: Mapping[str, Mapping[str, int]] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, documents: str = "documents", domain: str | None = None) -> str:
    """The same in DuckDB SQL, without the buckets. domain: SQL of a source's domain; crc32 is not in DuckDB, so a CASE over the source names by default."""
    import zlib

    names = [f"src{k}" for k in range(20)]
    domain = domain or "CASE source " + " ".join(f"WHEN '{s}' THEN 'domain{zlib.crc32(s.encode()) % 4}'" for s in names) + f" ELSE 'domain{zlib.crc32(NONE.encode()) % 4}' END"
    parts = [f"WITH r AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n_tokens FROM {documents}),"]
    parts.append("k AS (SELECT * FROM r WHERE n_tokens > 0),\nleaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM k GROUP BY ALL),")
    parts.append(f"b0 AS (SELECT least(floor(sum(tokens) * {budget_share})::BIGINT, sum(tokens)::BIGINT * {max_epochs}) AS budget FROM leaf),")
    for depth in range(1, len(LEVELS) + 1):
        above, own = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
        weight = "CASE " + own[-1] + "".join(f" WHEN '{v}' THEN {w}" for v, w in weights.get(own[-1], {}).items()) + " ELSE 1 END" if weights.get(own[-1]) else "1"
        part = "PARTITION BY " + ", ".join(above) if above else ""
        join = f"JOIN b{depth - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
        parts.append(f"""n{depth} AS (SELECT {", ".join(own)}, sum(tokens)::BIGINT * {max_epochs} AS cap, {weight} AS w FROM leaf GROUP BY {", ".join(own)}),
c{depth} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0, coalesce(sum(w) OVER ({part} ORDER BY cap / w, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w0, sum(w) OVER ({part})::BIGINT AS wt FROM n{depth} {join}),
f{depth} AS (SELECT *, (budget - c0)::DOUBLE / (wt - w0)::DOUBLE AS lvl, cap::DOUBLE <= (budget - c0)::DOUBLE / (wt - w0)::DOUBLE * w::DOUBLE AS is_full FROM c{depth}),
g{depth} AS (SELECT *, max(CASE WHEN NOT is_full THEN lvl END) OVER ({part}) AS water, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ({part})::BIGINT AS w1 FROM f{depth}),
b{depth} AS (SELECT {", ".join(own)}, CASE WHEN is_full THEN cap ELSE least(cap, (floor((w0 + w - w1)::DOUBLE * water + 1e-6) - floor((w0 - w1)::DOUBLE * water + 1e-6))::BIGINT) END AS budget FROM g{depth}),""")
    parts.append(f"""p AS (SELECT k.*, budget // tokens AS full_epochs, budget % tokens AS rest FROM k JOIN leaf USING (domain, lang, source) JOIN b{len(LEVELS)} USING (domain, lang, source)),
h AS (SELECT *, ('0x' || substr(md5('{seed}:' || full_epochs || ':' || doc_id), 1, 15))::BIGINT AS place FROM p),
s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h)
SELECT doc_id, domain, lang, source, n_tokens, full_epochs, full_epochs * n_tokens + greatest(0, least(n_tokens, rest - before)) AS tokens_taken
FROM s WHERE full_epochs * n_tokens + greatest(0, least(n_tokens, rest - before)) > 0""")
    return "\n".join(parts)
