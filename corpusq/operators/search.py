"""Top-k vector search for a whole table of questions.

* `top_k`: the exact search, one kernel at every size. The question matrix is broadcast, in
  blocks of a checked size; the corpus is read once for as many blocks as `PASS_BYTES` hold, dealt out to all cores if the
  questions are many; each task keeps k hits per question, and only those are shuffled.
* `top_k_cells`: vectors are put in cells around centroids, and a question visits cells near it. Question and
  vector rows meet in an equi-join on (cell, slices); slices split big cells
  on both sides, so no group grows with the data. Without `n_probe` it leaves out only cells that the triangle inequality
  rules out up to a fixed margin of rounding; ties and very long vectors are told apart reliably by `top_k` only.

With `n_probe` the cell search visits only that many nearest cells, which is
the approximate search.

Pairs are scored in numpy blocks inside the tasks; pairs that are not among the
k best of their block are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.blocks import Best, add_all, distances, hit_batch, keys_of, nearest, prepared, to_matrix
from corpusq.session import materialize, spread

# Bytes the broadcast question matrix may have (8 bytes per value).
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of question blocks that one pass over the vectors takes along.
PASS_BYTES = 64 * 1024 * 1024
# Bytes of questions from which scoring a vector takes much longer than moving it to another core.
DEAL_BYTES = 512 * 1024
# Bytes of vectors on one side of a cell group (8 bytes per value).
SLICE_BYTES = 32 * 1024 * 1024
_HIGHER_IS_BETTER = {"cosine": True, "l2": False}


# --- the operators ----------------------------------------------------------


def _narrow(df: DataFrame, keys: Sequence[str], embedding: str) -> DataFrame:
    """Only keys and vector, so that no other column is read or moved; rows without a vector drop out."""
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in keys], embedding).where(F.col(embedding).isNotNull())


def _usable(df: DataFrame, metric: str, embedding: str) -> DataFrame:
    """Rows whose vector can be scored: finite, and for cosine not without length."""
    finite = df.where(F.forall(embedding, lambda x: F.abs(x) < float("inf")))
    return finite.where(F.exists(embedding, lambda x: x != 0)) if metric == "cosine" else finite


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _schema(question_id: str, keys: Sequence[str]) -> str:
    return ", ".join(f"{c} bigint" for c in (question_id, *keys)) + ", score double"


def _ranked(hits: DataFrame, question_id: str, keys: Sequence[str], k: int, offset: int, metric: str) -> DataFrame:
    """Final rank. The input has at most k rows per question and task, so a
    question's group is bounded by the number of tasks, not by the corpus."""
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), *keys)
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + k)
    shown = F.col("score") if _HIGHER_IS_BETTER[metric] else -F.col("score")
    return ranked.where(F.col("rank") > offset).select(
        question_id, (F.col("rank") - offset).alias("rank"), *keys, shown.alias("score")
    )


def top_k_scan(
    questions: DataFrame, vectors: DataFrame, k: int, offset: int = 0, metric: str = "cosine",
    question_id: str = "question_id", keys: Sequence[str] = ("id",), embedding: str = "embedding", block: Column | None = None,
) -> DataFrame:
    """Exact search with a broadcast question matrix. The caller has checked its size. With `block`, the number of a
    question's block, every block is a broadcast of its own."""
    keys = list(keys)
    spark = questions.sparkSession
    numbered = questions.withColumn("_block", F.lit(0) if block is None else block)
    table = _narrow(numbered, [question_id, "_block"], embedding).toArrow()
    ids, of = (np.asarray(table.column(n)).astype(np.int64) for n in range(2))
    matrix = to_matrix(table.column(2))
    places = [np.flatnonzero(of == n) for n in np.unique(of)] if block is not None else [np.arange(len(ids))]
    shared = [spark.sparkContext.broadcast((ids[p], matrix[p])) for p in places]
    wanted = k + offset

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [part.value for part in shared]
        bests = [Best(asked, wanted, len(keys), metric) for _, asked in held]
        for batch in batches:
            if batch.num_rows:
                add_all(bests, keys_of(batch, keys), to_matrix(batch.column(embedding)))
        for (question_ids, _), best in zip(held, bests):
            yield hit_batch(best, question_ids, question_id, keys)

    hits = _narrow(vectors, keys, embedding).mapInArrow(scan, _schema(question_id, keys))
    return _ranked(hits, question_id, keys, k, offset, metric)


@dataclass(frozen=True)
class Cells:
    """Vectors with their cell, and per cell its size and radius."""

    assigned: DataFrame  # keys, embedding, cell
    centroids: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    keys: tuple[str, ...]
    metric: str


def build_cells(
    vectors: DataFrame, n_cells: int, metric: str = "cosine", keys: Sequence[str] = ("id",),
    embedding: str = "embedding", seed: int = 0, max_iter: int = 5,
) -> Cells:
    """Fit `n_cells` centroids and put every vector in the cell of the nearest one.

    The centroids are fitted on all usable vectors by distributed k-means. Centroids (`n_cells` x
    dimension) and one row of statistics per cell are all that comes to the driver.
    """
    keys = list(keys)
    data = _narrow(vectors, keys, embedding)
    sample = _usable(data.select(embedding), metric, embedding)
    if sample.isEmpty():
        raise ValueError("no vector to build cells from")
    points = sample.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    fit = KMeans(
        k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine" if metric == "cosine" else "euclidean"
    ).fit(points)
    centroids = np.array(fit.clusterCenters())
    if metric == "cosine":
        centroids = prepared(centroids, metric)[0]
    shared = data.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, usable = prepared(to_matrix(batch.column(embedding)), metric)
            cell, gap = nearest(matrix, shared.value)
            out = batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("gap", pa.array(gap))
            yield out.filter(pa.array(usable))

    assigned = materialize(data.mapInArrow(assign, _columns(data) + ", cell int, gap double"), "cells")
    counts, radii = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
    for row in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect():
        counts[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    return Cells(assigned.drop("gap"), centroids, counts, radii, tuple(keys), metric)


def _visits(cells: Cells, wanted: int, n_probe: int | None) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which cells each question visits, as (question row, cell) pairs."""
    centroids, counts, radii = cells.centroids, cells.counts, cells.radii

    def choose(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = distances(matrix, centroids)
        gaps[:, counts == 0] = np.inf
        if n_probe is not None:
            order = np.argsort(gaps, axis=1, kind="stable")[:, :n_probe]
            chosen = np.zeros(gaps.shape, dtype=bool)
            np.put_along_axis(chosen, order, True, axis=1)
            return np.nonzero(chosen & np.isfinite(gaps))
        # `wanted` vectors lie within the smallest far bounds that together hold as many
        far = gaps + radii
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(counts[order], axis=1) >= wanted
        first = np.where(enough.any(axis=1), enough.argmax(axis=1), far.shape[1] - 1)
        limit = np.take_along_axis(far, np.take_along_axis(order, first[:, None], axis=1), axis=1)
        limit = np.where(enough.any(axis=1)[:, None], limit, np.inf)
        near = gaps - radii
        return np.nonzero((near <= limit + 1e-6) & np.isfinite(gaps))

    return choose


def _sliced(df: DataFrame, own: DataFrame, other: DataFrame, own_id: Sequence[str], own_slice: str, other_slice: str):
    """Put each row in one slice of its own side, and copy it to every slice the
    other side has in its cell."""
    both = own.select("cell", F.col("slices").alias("_own")).join(
        other.select("cell", F.col("slices").alias("_other")), "cell"
    ).where("_own > 0 and _other > 0")  # a filter, so that partitions of other cells are pruned
    return (
        df.join(F.broadcast(both), "cell")  # one row per cell
        .withColumn(own_slice, F.pmod(F.xxhash64(*own_id), F.col("_own")).cast("int"))
        .withColumn(other_slice, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        .drop("_own", "_other")
    )


def top_k_cells(
    questions: DataFrame, cells: Cells, k: int, n_probe: int | None = None, offset: int = 0,
    question_id: str = "question_id", embedding: str = "embedding", slice_rows: int | None = None,
) -> DataFrame:
    """Search by cells: exact without `n_probe`, approximate with it."""
    slice_rows = slice_rows or max(1, SLICE_BYTES // (8 * cells.centroids.shape[1]))
    keys, metric, wanted = list(cells.keys), cells.metric, k + offset
    spark = questions.sparkSession
    choose = _visits(cells, wanted, n_probe)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, usable = prepared(to_matrix(batch.column(embedding)), metric)
            rows, cell = choose(matrix)
            keep = usable[rows]
            rows, cell = rows[keep], cell[keep]
            asking = batch.column(question_id).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([asking, pa.array(cell.astype(np.int32))], names=[question_id, "cell"])

    asked = _narrow(questions, [question_id], embedding)
    # only pairs of ids are written; vectors join them where they are needed
    visits = materialize(asked.mapInArrow(visit, f"{question_id} bigint, cell int"), "visits")
    sizes = spark.createDataFrame(
        [(c, int(n)) for c, n in enumerate(cells.counts) if n], "cell int, n bigint"
    )
    return score_visits(
        asked, visits, cells.assigned, sizes, keys, k, offset, metric, question_id, embedding, slice_rows
    )


def score_visits(
    asked: DataFrame, visits: DataFrame, assigned: DataFrame, sizes: DataFrame, keys: Sequence[str], k: int, offset: int,
    metric: str, question_id: str, embedding: str, slice_rows: int,
) -> DataFrame:
    """Score each question against the vectors of the cells it visits.

    `visits (question_id, cell)` is stored; `assigned` holds keys, vector and cell, `sizes (cell, n)` one row per cell. Slices
    bound both sides of every group. If `assigned` is partitioned by cell, cells that nobody visits are not read.
    """
    wanted = k + offset

    def slices(counts: DataFrame) -> DataFrame:
        return counts.select("cell", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))

    vector_slices = slices(sizes)
    question_slices = slices(visits.groupBy("cell").agg(F.count("*").alias("n")))
    left = _sliced(visits.join(asked, question_id), question_slices, vector_slices, [question_id], "q_slice", "v_slice")
    right = _sliced(assigned, vector_slices, question_slices, keys, "v_slice", "q_slice")

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = [question_id, *keys, "score"]
        if not asked.num_rows or not held.num_rows:
            empty = [pa.array([], pa.int64())] * (len(names) - 1) + [pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=names)
        best = Best(to_matrix(asked.column(embedding)), wanted, len(keys), metric)
        best.add(keys_of(held, keys), to_matrix(held.column(embedding)))
        ids = np.asarray(asked.column(question_id)).astype(np.int64)
        return pa.Table.from_batches([hit_batch(best, ids, question_id, keys)])

    by = ["cell", "v_slice", "q_slice"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, _schema(question_id, keys))
    return _ranked(hits, question_id, keys, k, offset, metric)


def fits_broadcast(questions: DataFrame, embedding: str = "embedding", limit: int = BROADCAST_BYTES) -> bool:
    """Whether the question matrix stays within `limit` bytes; null vectors take no room."""
    return matrix_bytes(questions, embedding) <= limit


def matrix_bytes(questions: DataFrame, embedding: str = "embedding") -> int:
    """Size of the question matrix as doubles: rows with a vector times the longest vector."""
    row = questions.where(F.col(embedding).isNotNull()).agg(F.count("*").alias("n"), F.max(F.size(embedding)).alias("d")).first()
    return 8 * row["n"] * (row["d"] or 0)


def top_k(
    questions: DataFrame, vectors: DataFrame, k: int = 2, offset: int = 0, metric: str = "cosine",
    question_id: str = "question_id", keys: Sequence[str] = ("id",), embedding: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES, small: bool | None = None,
) -> DataFrame:
    """The k nearest vectors of every question: `(question_id, rank, keys, score)`.

    Exact, ties by key, by one kernel at every size. With `offset` the hits after the first `offset` are
    given. Questions are cut into blocks whose matrix stays within `broadcast_bytes`. One pass over the vectors takes
    as many blocks along as `PASS_BYTES` hold, one at least, and its hits are stored before the next pass. `small` says that the caller has
    checked that one block is enough.
    """
    if metric not in _HIGHER_IS_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    size = 0 if small else matrix_bytes(questions, embedding)
    if size >= DEAL_BYTES:
        vectors = spread(_narrow(vectors, keys, embedding))
    blocks = max(1, -(-size // broadcast_bytes))
    if blocks == 1:
        return top_k_scan(questions, vectors, k, offset, metric, question_id, keys, embedding)
    blocks = _fitting_blocks(questions, blocks, broadcast_bytes, question_id, embedding)
    block = F.pmod(F.xxhash64(question_id), F.lit(blocks))
    together = max(1, PASS_BYTES // broadcast_bytes)
    if blocks > together:
        vectors = materialize(_narrow(vectors, keys, embedding), "searched")
    hits = [
        materialize(
            top_k_scan(
                questions.where((block >= n) & (block < n + together)), vectors, k, offset, metric, question_id, keys, embedding, block
            ),
            "block-hits",
        )
        for n in range(0, blocks, together)
    ]
    return reduce(DataFrame.union, hits)


def _fitting_blocks(questions: DataFrame, blocks: int, limit: int, question_id: str, embedding: str) -> int:
    """A number of blocks of which the largest, measured, stays within `limit` bytes. An id's rows stay together, so where
    repeated ids alone are larger the search is refused."""
    rows = questions.where(F.col(embedding).isNotNull()).select(question_id, F.size(embedding).alias("d"))
    for _ in range(8):
        blocks *= 2
        sizes = rows.groupBy(F.pmod(F.xxhash64(question_id), F.lit(blocks))).agg((8 * F.count("*") * F.max("d")).alias("bytes"))
        if (sizes.agg(F.max("bytes")).first()[0] or 0) <= limit:
            return blocks
    raise ValueError("one question id has more vectors than a block may hold")


def recall(found: DataFrame, exact: DataFrame, question_id: str = "question_id", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Share of the exact hits that an approximate search found, one row."""
    on = [question_id, *keys]
    hit = found.select(*on).withColumn("_hit", F.lit(1))
    return exact.select(*on).join(hit, on, "left").agg(
        F.count("*").alias("expected"), F.count("_hit").alias("found")
    ).withColumn("recall", F.try_divide("found", "expected"))
