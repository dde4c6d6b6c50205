"""Approximate nearest neighbours: vectors in cells around k-means centres, a question reads the cells nearest to it.

The centres are fitted on a bounded sample of the vectors, the rounds of k-means
are Spark jobs over it.  Every vector is then put into its nearest centre's
cell, and stored in folders by cell; a search of all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import QUERY_BLOCK

#: Vectors that the centres are fitted on, at most; centres that are held in memory, at most.
SAMPLE, MOST_CELLS = 200_000, 4096
CELLS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("center", T.ArrayType(T.DoubleType()))])


def _nearest_cells(matrix: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first, ties to the lower."""
    distance = (centers**2).sum(1)[None, :] - 2 * matrix @ centers.T
    return np.argsort(np.round(distance, 9), axis=1, kind="stable")[:, :n]


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def train(vectors: DataFrame, cells: int, key: str = "chunk_id", rounds: int = 10, sample: int = SAMPLE) -> np.ndarray:
    """Centres (cells x dimension; fewer if there are fewer vectors) of vectors (key, embedding).

    The sample is the vectors with the lowest hashes of their keys, the first
    centres are its first ones; a cell that loses all its vectors keeps its
    centre.  Null and empty vectors are left out, all others must have one
    length.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"there are 1 to {MOST_CELLS} cells")
    order = F.struct(F.xxhash64(key), key)
    own = _usable(vectors).select(order.alias("o"), "embedding").orderBy("o").limit(sample).select("o", "embedding").persist()
    centers = np.array([r["embedding"] for r in own.orderBy("o").limit(cells).collect()], np.float64)
    for _ in range(rounds if len(centers) else 0):

        def partial(parts: Iterator[pd.DataFrame], centers: np.ndarray = centers) -> Iterator[pd.DataFrame]:
            for part in parts:
                matrix = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                at = _nearest_cells(matrix, centers)[:, 0]
                found, where = np.unique(at, return_inverse=True)
                sums = np.zeros((len(found), matrix.shape[1]))
                np.add.at(sums, where, matrix)
                yield pd.DataFrame({"cell": found.astype(np.int32), "total": list(sums), "n": np.bincount(where)})

        sums = own.select("embedding").mapInPandas(partial, "cell int, total array<double>, n long")
        each = sums.select("cell", "n", F.posexplode("total").alias("axis", "x")).groupBy("cell", "axis").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        moved = each.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("axis", (F.col("x") / F.col("n")).alias("x")))).alias("c")).select("cell", "c.x")
        new = centers.copy()
        for row in moved.collect():  # MOST_CELLS at most
            new[row["cell"]] = row["x"]
        settled = np.allclose(new, centers)
        centers = new
        if settled:
            break
    own.unpersist()
    return centers


def assigned(vectors: DataFrame, centers: np.ndarray, key: str = "chunk_id") -> DataFrame:
    """The usable vectors' columns and cell, the nearest centre's number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cell=_nearest_cells(np.stack(part["embedding"].to_numpy()).astype(np.float64), centers)[:, 0].astype(np.int32))

    return _usable(vectors).mapInPandas(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))


def center_rows(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centers)], CELLS)


def centers_of(rows: DataFrame) -> np.ndarray:
    """Centres as an array, from a table (cell, center)."""
    return np.array([r["center"] for r in rows.orderBy("cell").collect()], np.float64)  # MOST_CELLS at most


def search(cells: DataFrame, centers: np.ndarray, queries: Sequence[tuple], n: int, probes: int, key: str = "chunk_id") -> DataFrame:
    """question_id, key, distance, rank: of each of queries (id, vector) the n nearest among the vectors of its probes nearest cells, ties by key.

    cells (key, embedding, cell) is read once for QUERY_BLOCK queries, and of it
    only the folders of cells that one of them probes.  A task compares a vector
    with the queries that probe its cell and keeps n rows of each for a batch.
    """
    spark = cells.sparkSession
    ids = T.LongType() if all(isinstance(q, int) for q, _ in queries) else T.StringType()
    schema = T.StructType([T.StructField("question_id", ids), cells.schema[key], T.StructField("distance", T.DoubleType())])
    best = None
    for i in range(0, len(queries) if len(centers) else 0, QUERY_BLOCK):
        some = queries[i : i + QUERY_BLOCK]
        matrix = np.array([v for _, v in some], np.float64)
        probed = _nearest_cells(matrix, centers, probes)
        of_cell = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
        wanted = cells.where(F.col("cell").isin(list(of_cell))).select(key, "embedding", "cell")
        found = wanted.mapInPandas(_in_cells([q for q, _ in some], matrix, of_cell, n, key), schema)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], schema)
    order = Window.partitionBy("question_id").orderBy(F.round("distance", 9), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _in_cells(ids: list, queries: np.ndarray, of_cell: dict[int, np.ndarray], n: int, key: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for cell, own in part.groupby("cell", sort=False):
                matrix, keys = np.stack(own["embedding"].to_numpy()).astype(np.float64), own[key].to_numpy()
                for q in of_cell[int(cell)]:
                    distance = ((matrix - queries[q]) ** 2).sum(1)
                    order = np.lexsort((keys, np.round(distance, 9)))[:n]
                    yield pd.DataFrame({"question_id": [ids[q]] * len(order), key: keys[order], "distance": distance[order]})

    return run
