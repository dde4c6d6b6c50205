"""Vector search, and its union with keyword search under the status rule."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EXHAUSTIVE
from ..functions.text import is_exhaustive as text_is_exhaustive
from .keyword import KeywordIndex, search, search_many

# fixed values: numbers of hits
SPECIFIC_TOP, EXHAUSTIVE_TOP, EXHAUSTIVE_KEYWORD = 6, 40, 60
#: Queries whose vectors a task holds at a time.
QUERY_BLOCK = 1024


def squared_distance(embedding: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(embedding, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def nearest(vectors: DataFrame, query: Sequence[float], n: int, key: str = "chunk_id") -> DataFrame:
    """key, distance (squared Euclidean, exact) of the n nearest, ties by key."""
    return vectors.select(key, squared_distance(F.col("embedding"), query).alias("distance")).orderBy(F.round("distance", 9), key).limit(n)


def score(distance: Column) -> Column:
    return F.coalesce(1 / (1 + distance), F.lit(0.0))


def is_exhaustive(question: str) -> bool:
    return re.search(EXHAUSTIVE, question) is not None


def merge(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """chunk_id, score, source, rank_in_source: vector hits, and keyword hits that are not among them."""
    by_distance, by_bm25 = Window.orderBy(F.round("distance", 9), "chunk_id"), Window.orderBy(F.round("bm25", 9), "chunk_id")  # 100 rows at most
    v = vector_hits.select("chunk_id", score(F.col("distance")).alias("score"), F.lit("vector").alias("source"), F.row_number().over(by_distance).alias("rank_in_source"))
    k = keyword_hits.select("chunk_id", F.lit(0.0).alias("score"), F.lit("keyword").alias("source"), F.row_number().over(by_bm25).alias("rank_in_source"))
    return v.unionByName(k.join(v.select("chunk_id"), "chunk_id", "left_anti"))


def ranked(hits: DataFrame, exhaustive: bool, top: int = SPECIFIC_TOP) -> DataFrame:
    """Hits (with status) by score, ties vector first and then in their own order; specific mode leaves out superseded ones unless all are, and cuts."""
    hits = hits.withColumn("status", F.coalesce("status", F.lit("current")))
    if not exhaustive:
        everything = Window.partitionBy(F.lit(0))  # 100 rows at most
        hits = hits.withColumn("n_current", F.count_if(F.col("status") != "superseded").over(everything)).where((F.col("n_current") == 0) | (F.col("status") != "superseded")).drop("n_current")
    order = Window.orderBy(F.round("score", 9).desc(), F.col("source").desc(), "rank_in_source", "chunk_id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if exhaustive else out.where(F.col("rank") <= top)


def retrieve(question: str, chunks: DataFrame, index: KeywordIndex, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, exhaustive: bool | None = None) -> tuple[DataFrame, str]:
    """Hits with the chunk's columns, score, source and rank, and the mode. Status is always read from chunks."""
    exhaustive = is_exhaustive(question) if exhaustive is None else exhaustive
    found = search(index, question, EXHAUSTIVE_KEYWORD if exhaustive else SPECIFIC_TOP)
    if vectors is not None and query_vector is not None:
        near = nearest(vectors, query_vector, EXHAUSTIVE_TOP if exhaustive else SPECIFIC_TOP)
    else:
        near = chunks.sparkSession.createDataFrame([], "chunk_id string, distance double")
    hits = F.broadcast(merge(near, found)).join(_hit_columns(chunks), "chunk_id")  # 100 rows at most
    return ranked(hits, exhaustive), "exhaustive" if exhaustive else "specific"


def nearest_many(vectors: DataFrame, queries: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """question_id, key, distance, rank: the n nearest of each of queries (question_id, embedding), as ``nearest`` finds them one by one.

    All vectors are read once for each block of QUERY_BLOCK queries; a task
    keeps n rows of a query for each Arrow batch.  Vectors of another length
    than a query's, and null ones, are no hits.
    """
    asked = [(r["question_id"], r["embedding"]) for r in queries.where("embedding is not null").select("question_id", "embedding").toLocalIterator()]
    kinds = vectors.schema[key].dataType.simpleString(), queries.schema["question_id"].dataType.simpleString()
    schema = f"question_id {kinds[1]}, {key} {kinds[0]}, distance double"
    best = None
    for i in range(0, len(asked), QUERY_BLOCK):
        found = vectors.where("embedding is not null").select(key, "embedding").mapInPandas(_nearest_in_batch(asked[i : i + QUERY_BLOCK], n, key), schema)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = queries.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("question_id").orderBy(F.round("distance", 9), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _nearest_in_batch(asked: list[tuple], n: int, key: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length: dict[int, list] = {}
        for question, vector in asked:
            by_length.setdefault(len(vector), []).append((question, np.asarray(vector, np.float64)))
        for part in parts:
            size = part["embedding"].map(len).to_numpy()
            for length, own in by_length.items():
                keys = part[key].to_numpy()[size == length]
                if not len(keys):
                    continue
                matrix = np.stack(part["embedding"].to_numpy()[size == length]).astype(np.float64)
                for question, vector in own:
                    distance = ((matrix - vector) ** 2).sum(1)
                    order = np.lexsort((keys, np.round(distance, 9)))[:n] if len(keys) > n else np.arange(len(keys))
                    yield pd.DataFrame({"question_id": question, key: keys[order], "distance": distance[order]})

    return run


def retrieve_many(questions: DataFrame, chunks: DataFrame, index: KeywordIndex, vectors: DataFrame | None = None) -> DataFrame:
    """question_id, rank, and the columns of ``retrieve``'s hits for every question (question_id, question, exhaustive, embedding if there are vectors), in one plan.

    A null exhaustive is found from the question.
    """
    mode = F.coalesce("exhaustive", text_is_exhaustive(F.col("question")))
    asked = questions.withColumn("exhaustive", mode)
    found = search_many(index, asked, F.when(F.col("exhaustive"), EXHAUSTIVE_KEYWORD).otherwise(SPECIFIC_TOP))
    k = found.select("question_id", "chunk_id", F.lit(0.0).alias("score"), F.lit("keyword").alias("source"), F.col("rank").alias("rank_in_source"))
    hits = k
    if vectors is not None:
        near = nearest_many(vectors, asked, EXHAUSTIVE_TOP).join(asked.select("question_id", "exhaustive"), "question_id").where(F.col("exhaustive") | (F.col("rank") <= SPECIFIC_TOP))
        v = near.select("question_id", "chunk_id", score(F.col("distance")).alias("score"), F.lit("vector").alias("source"), F.col("rank").alias("rank_in_source"))
        hits = v.unionByName(k.join(v.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti"))
    hits = hits.join(asked.select("question_id", "exhaustive"), "question_id").join(_hit_columns(chunks), "chunk_id").withColumn("status", F.coalesce("status", F.lit("current")))
    own = Window.partitionBy("question_id")  # 100 rows at most
    hits = hits.withColumn("n_current", F.count_if(F.col("status") != "superseded").over(own)).where(F.col("exhaustive") | (F.col("n_current") == 0) | (F.col("status") != "superseded")).drop("n_current")
    order = own.orderBy(F.round("score", 9).desc(), F.col("source").desc(), "rank_in_source", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("exhaustive") | (F.col("rank") <= SPECIFIC_TOP)).drop("exhaustive")


def _hit_columns(chunks: DataFrame) -> DataFrame:
    """A chunk's columns as a hit shows them."""
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    page = lambda name: F.nullif(F.col(name), F.lit(0)).alias(name)
    return chunks.select("chunk_id", "text", "title", "section_path", text("date"), "source_url", text("local_path"), text("clause_ref"), page("page_start"), page("page_end"), text("circular_number"), "status", text("status_note"))


def validate(cases: DataFrame, chunks: DataFrame, index: KeywordIndex, vectors: DataFrame | None = None) -> DataFrame:
    """question, passed, reason of all cases (question, expected_number, expected_keyword, exhaustive; embedding if there are vectors), in one plan."""
    asked = cases.withColumn("question_id", F.col("question")).dropDuplicates(["question"])
    cited = retrieve_many(asked, chunks, index, vectors).select(F.col("question_id").alias("question"), "circular_number", "title")
    return judged_cases(cases.select("question", "expected_number", "expected_keyword"), cited)


def citations(hits: DataFrame) -> DataFrame:
    """One citation for each chunk supplied, in rank order."""
    return hits.select("rank", "title", "date", "circular_number", "section_path", "clause_ref", "page_start", "page_end", "source_url", "local_path", "status", "status_note")


def judged_cases(cases: DataFrame, cited: DataFrame) -> DataFrame:
    """question, passed, reason. cited: question, circular_number, title, a row for each citation.

    No expectation fails, then no chunk fails, then a number or title that
    contains the expected string, whatever its case, passes.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    has = lambda have, want: (F.coalesce(F.col(want), F.lit("")) != "") & F.contains(low(F.col(have)), low(F.col(want)))
    joined = cases.join(cited.withColumn("cited", F.lit(1)), "question", "left")
    found = joined.groupBy("question", "expected_number", "expected_keyword").agg(F.max(F.coalesce(has("circular_number", "expected_number") | has("title", "expected_keyword"), F.lit(False))).alias("hit"), F.count("cited").alias("n"))
    nothing = (F.coalesce("expected_number", F.lit("")) == "") & (F.coalesce("expected_keyword", F.lit("")) == "")
    reason = F.when(nothing, "no expected_number/expected_keyword given -- nothing to check").when(F.col("n") == 0, "no chunks retrieved at all").when(F.col("hit"), "expected circular found in citations").otherwise("expected circular NOT found among citations")
    return found.select("question", (~nothing & (F.col("n") > 0) & F.col("hit")).alias("passed"), reason.alias("reason"))
