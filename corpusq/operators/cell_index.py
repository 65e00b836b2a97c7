"""A stored index of cells for approximate vector search.

Three tables in one folder: `centroids (cell, centroid)`, `lists` (keys, vector; one partition for each cell) and `stats`
(vectors of each cell, one row for each cell and load). Centroids are fitted once, or given. Later vectors are put
into the cells that are there, so a load reads and writes the new vectors only. A search finds each question's nearest cells and
reads the partitions of these cells only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.blocks import SCORE_DECIMALS, distances, prepared, to_matrix
from corpusq.operators.search import BROADCAST_BYTES, SLICE_BYTES, _columns, _narrow, build_cells, score_visits
from corpusq.session import materialize


@dataclass(frozen=True)
class CellIndex:
    """A stored index: its folder, and the centroids (one row for each cell, checked to be small)."""

    path: str
    cells: np.ndarray
    centroids: np.ndarray
    keys: tuple[str, ...]
    metric: str
    embedding: str = "embedding"

    def lists(self, spark: SparkSession) -> DataFrame:
        """All vectors with their cell, partitioned by it."""
        return spark.read.parquet(f"{self.path}/lists")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """`(cell, n)`."""
        return spark.read.parquet(f"{self.path}/stats").groupBy("cell").agg(F.sum("n").alias("n"))


def _ranking(matrix: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Cells of each row in the order of nearness. Nearness is compared at the decimals of scores; the first of equals is the
    smaller cell."""
    near = matrix @ centroids.T if metric == "cosine" else -distances(matrix, centroids)
    return np.argsort(-np.round(near, SCORE_DECIMALS), axis=1, kind="stable")


def create_index(
    vectors: DataFrame, path: str, n_cells: int | None = None, centroids: DataFrame | None = None, metric: str = "cosine",
    keys: Sequence[str] = ("id",), embedding: str = "embedding", seed: int = 0,
) -> CellIndex:
    """Write an index of `vectors` to the folder `path`.

    `centroids (cell, centroid)` are given, or `n_cells` of them are fitted by distributed k-means.
    """
    spark = vectors.sparkSession
    if centroids is None:
        if not n_cells:
            raise ValueError("give centroids or their number")
        fit = build_cells(vectors, n_cells, metric, keys, embedding, seed)
        rows = [(c, [float(x) for x in v]) for c, v in enumerate(fit.centroids)]
        centroids = spark.createDataFrame(rows, "cell int, centroid array<double>")
    centroids.select(F.col("cell").cast("int").alias("cell"), F.col("centroid").cast("array<double>").alias("centroid")).write.parquet(f"{path}/centroids")
    index = open_index(spark, path, metric, keys, embedding)
    add_vectors(index, vectors)
    return index


def open_index(
    spark: SparkSession, path: str, metric: str = "cosine", keys: Sequence[str] = ("id",), embedding: str = "embedding"
) -> CellIndex:
    """An index that was written before. Its centroids are read, their size checked first."""
    held = spark.read.parquet(f"{path}/centroids")
    size = held.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if not size["n"]:
        raise ValueError("an index needs centroids")
    if 8 * size["n"] * size["d"] > BROADCAST_BYTES:
        raise ValueError("centroids do not fit in a broadcast: use fewer cells")
    rows = held.orderBy("cell").collect()
    matrix = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return CellIndex(path, np.array([r["cell"] for r in rows], dtype=np.int32), prepared(matrix, metric)[0], tuple(keys), metric, embedding)


def add_vectors(index: CellIndex, vectors: DataFrame) -> None:
    """Put more vectors into the cells that are there. Vectors that cannot be scored (without length for cosine, not
    finite) are left out, as the search leaves them out."""
    spark = vectors.sparkSession
    data = _narrow(vectors, index.keys, index.embedding)
    shared = spark.sparkContext.broadcast((index.cells, index.centroids))
    metric, embedding = index.metric, index.embedding

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids = shared.value
        for batch in batches:
            if batch.num_rows:
                matrix, usable = prepared(to_matrix(batch.column(embedding)), metric)
                own = cells[_ranking(np.where(usable[:, None], matrix, 0.0), centroids, metric)[:, 0]]
                yield batch.append_column("cell", pa.array(own)).filter(pa.array(usable))

    # the load is stored once, so its counts and its lists are of the same rows
    load = materialize(data.mapInArrow(assign, _columns(data) + ", cell int"), "load")
    # few files for each cell, a large cell in several tasks
    load.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/lists")
    load.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{index.path}/stats")


def probes(index: CellIndex, questions: DataFrame, n_probe: int, question_id: str = "question_id") -> DataFrame:
    """`(question_id, cell)`: the `n_probe` nearest cells of each question, stored."""
    asked = _narrow(questions, [question_id], index.embedding)
    shared = questions.sparkSession.sparkContext.broadcast((index.cells, index.centroids))
    metric, embedding = index.metric, index.embedding

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids = shared.value
        for batch in batches:
            if batch.num_rows:
                matrix, usable = prepared(to_matrix(batch.column(embedding)), metric)
                rows = np.flatnonzero(usable)
                chosen = cells[_ranking(matrix[rows], centroids, metric)[:, :n_probe]]
                asking = batch.column(question_id).take(pa.array(np.repeat(rows, chosen.shape[1])))
                yield pa.RecordBatch.from_arrays([asking, pa.array(chosen.ravel())], names=[question_id, "cell"])

    return materialize(asked.mapInArrow(visit, f"{question_id} bigint, cell int"), "probes")


def search_index(
    index: CellIndex, questions: DataFrame, k: int = 2, n_probe: int = 4, offset: int = 0, question_id: str = "question_id",
    slice_rows: int | None = None,
) -> DataFrame:
    """The k best vectors in the nearest cells of every question: `(question_id, rank, keys, score)`.

    Only the probed cells' partitions are read: the list of probed cells (at most one row for each cell) prunes them when the
    search runs.
    """
    spark = questions.sparkSession
    slice_rows = slice_rows or max(1, SLICE_BYTES // (8 * index.centroids.shape[1]))
    asked = _narrow(questions, [question_id], index.embedding)
    return score_visits(
        asked, probes(index, questions, n_probe, question_id), index.lists(spark), index.sizes(spark), list(index.keys), k, offset,
        index.metric, question_id, index.embedding, slice_rows,
    )
