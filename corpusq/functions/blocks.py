"""Blocks of vectors inside a task: numpy helpers for the vector search.

Kept apart from the operators so that Python workers import little.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

# Scores computed at once inside a task (8 bytes each).
BLOCK_SCORES = 4_000_000
# Vectors of the first block that questions meet, and of later ones at most.
FIRST_ROWS = 512
BLOCK_ROWS = 8_192
_PAIRS = 65_536  # pairs scored at once
_FEW = 32  # pairs of a question in a block that are scored one by one
# Scores are compared at this many decimals, so that copies of a vector tie
# whatever order their products were summed in; ties go to the smaller key.
SCORE_DECIMALS = 9


def to_matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) == 0:
        return np.zeros((0, 0))
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def prepared(matrix: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors ready for scoring, and which of them can be scored at all: not
    those with values that are no numbers, and for cosine not those without
    length, as they have no direction."""
    usable = np.isfinite(matrix).all(axis=1) if len(matrix) else np.zeros(0, dtype=bool)
    if metric == "cosine" and len(matrix):
        size = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        usable &= size > 0
        matrix = matrix / np.where(usable, size, 1.0)[:, None]
    return matrix, usable


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs of a block, higher is better."""
    if metric == "cosine":
        raw = q @ v.T
    else:
        raw = np.empty((len(q), len(v)))
        for i in range(len(q)):
            gap = v - q[i]
            raw[i] = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return np.round(raw, SCORE_DECIMALS)


def _first_per_question(q: np.ndarray, keys: np.ndarray, s: np.ndarray, k: int):
    """The k best rows of every question, by score, then by key."""
    order = np.lexsort(tuple(keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)) + (-s, q))
    q, keys, s = q[order], keys[order], s[order]
    opens = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(opens, np.diff(np.r_[opens, len(q)]))
    keep = rank < k
    return q[keep], keys[keep], s[keep]


def _first_copies(keys: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their keys; of equal vectors the first k only, as others are among nobody's k best."""
    order = np.lexsort(tuple(keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)))
    keys, vectors = keys[order], np.ascontiguousarray(vectors[order] + 0.0)  # one kind of zero
    if len(keys) <= k or not vectors.shape[1]:
        return keys, vectors
    _, same = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    opens = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    keep = np.empty(len(keys), dtype=bool)
    keep[order] = np.arange(len(keys)) - np.repeat(opens, np.diff(np.r_[opens, len(keys)])) < k
    return (keys, vectors) if keep.all() else (keys[keep], vectors[keep])


def _pair_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of `q` with the same rows of `v`."""
    if metric == "cosine":
        raw = np.einsum("ij,ij->i", q, v)
    else:
        gap = v - q
        raw = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return np.round(raw, SCORE_DECIMALS)


class Best:
    """The k best hits seen so far for each row of a question matrix.

    All pairs of a block are first compared by one product in single precision. What may be among the k best, with a margin
    for its rounding, is then scored pair by pair. Questions that leave too many are compared in double precision, and
    then by the scores of all their pairs.
    """

    def __init__(self, questions: np.ndarray, k: int, n_keys: int, metric: str):
        self.matrix, self.usable = prepared(questions, metric)
        self.k, self.metric = k, metric
        self.q = np.zeros(0, dtype=np.int64)
        self.keys = np.zeros((0, n_keys), dtype=np.int64)
        self.s = np.zeros(0)
        self.floor = np.full(len(questions), -np.inf)  # score of the k-th hit so far
        self.square = np.einsum("ij,ij->i", self.matrix, self.matrix)
        self.rows = FIRST_ROWS  # of the next block: small until there are scores to beat

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        add_all([self], keys, vectors)

    def _add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        at = 0
        while at < len(vectors):
            rows = max(1, min(self.rows, BLOCK_SCORES))
            self._add_block(keys[at:at + rows], vectors[at:at + rows])
            at, self.rows = at + rows, min(2 * self.rows, BLOCK_ROWS)

    def _add_block(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, BLOCK_SCORES // len(vectors))
        square = np.einsum("ij,ij->i", vectors, vectors)
        sides: dict[type, np.ndarray] = {}
        found = [(self.q, self.keys, self.s)]
        for at in range(0, len(self.matrix), step):
            rows = at + np.flatnonzero(self.usable[at:at + step])
            for kind in (np.float32, np.float64):
                if len(rows):
                    q, v, rows = self._near(rows, vectors, square, kind, sides)
                    for a in range(0, len(q), _PAIRS):
                        x, y = q[a:a + _PAIRS], v[a:a + _PAIRS]
                        s = _pair_scores(self.matrix[x], vectors[y], self.metric)
                        good = s >= self.floor[x]
                        found.append((x[good], keys[y[good]], s[good]))
            if len(rows):
                found += self._every(rows, keys, vectors)
        self.q, self.keys, self.s = _first_per_question(
            np.concatenate([f[0] for f in found]),
            np.concatenate([f[1] for f in found]),
            np.concatenate([f[2] for f in found]),
            self.k,
        )
        count = np.bincount(self.q, minlength=len(self.matrix))
        full = count == self.k
        self.floor[full] = self.s[np.cumsum(count)[full] - 1]

    def _near(self, rows: np.ndarray, vectors: np.ndarray, square: np.ndarray, kind: type, sides: dict[type, np.ndarray]):
        """Pairs (question row, vector row) that may be among the k best, and the questions that have too many of them.

        Nearness is the product, for l2 less half the square of the vector: |q - v|^2 is |q|^2 less twice that.
        """
        none = np.zeros(0, dtype=np.int64)
        own, most = self.square[rows], square.max()
        if not own.max() + most < np.finfo(kind).max / 16:  # products could overflow
            return none, none, rows
        l2 = self.metric == "l2"
        if kind not in sides:
            sides[kind] = (np.column_stack([vectors, -square / 2]) if l2 else vectors).astype(kind)
        q = self.matrix[rows]
        near = (np.column_stack([q, np.ones(len(q))]) if l2 else q).astype(kind) @ sides[kind].T
        # rounding of the product, of the limit, and of the scores
        unit = 10.0 ** -SCORE_DECIMALS
        slack = (vectors.shape[1] + 8) * float(np.finfo(kind).eps) * (own + most) + 2 * unit * (np.sqrt(own) + np.sqrt(most) + unit) + 1e-36
        floor = self.floor[rows]
        limit = (own - (unit - floor) ** 2) / 2 - slack if l2 else floor - unit - slack
        new = ~np.isfinite(floor)
        if new.any() and near.shape[1] > self.k:
            place = near.shape[1] - self.k
            limit[new] = np.partition(near[new], place, axis=1)[:, place] - 2 * slack[new]
        close = np.flatnonzero(near >= limit.astype(kind)[:, None])
        at = close // near.shape[1]
        heavy = np.bincount(at, minlength=len(rows)) > max(_FEW, 4 * self.k)
        if heavy.any():
            keep = ~heavy[at]
            close, at = close[keep], at[keep]
        return rows[at], close % near.shape[1], rows[heavy]

    def _every(self, rows: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        """The k best of the block for the questions `rows`, from the scores of all pairs."""
        found = []
        s = _scores(self.matrix[rows], vectors, self.metric)
        place = np.arange(len(rows))
        for _ in range(min(self.k, len(vectors))):
            # the first of equal scores is the one with the smallest key
            vi = s[place].argmax(axis=1) if len(place) < len(s) else s.argmax(axis=1)
            top = s[place, vi]
            good = top >= self.floor[rows[place]]
            place, vi, top = place[good], vi[good], top[good]
            if not len(place):
                break
            found.append((rows[place], keys[vi], top))
            s[place, vi] = -np.inf
        return found


def add_all(bests: Sequence[Best], keys: np.ndarray, vectors: np.ndarray) -> None:
    """Show vectors to all of the `bests`, which have the same k and metric; vectors are made ready once."""
    if not bests:
        return
    vectors, usable = prepared(vectors, bests[0].metric)
    keys, vectors = _first_copies(keys[usable], vectors[usable], bests[0].k)
    for best in bests:
        if len(best.matrix):
            best._add(keys, vectors)


def keys_of(batch, names: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in names], axis=1)


def hit_batch(best: Best, question_ids: np.ndarray, question_id: str, keys: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(question_ids[best.q])] + [pa.array(best.keys[:, j]) for j in range(len(keys))]
    return pa.RecordBatch.from_arrays(columns + [pa.array(best.s)], names=[question_id, *keys, "score"])


def nearest(matrix: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = distances(matrix, centroids)
    cell = gaps.argmin(axis=1)
    return cell, gaps[np.arange(len(matrix)), cell]


def distances(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centroids."""
    square = (
        np.einsum("ij,ij->i", matrix, matrix)[:, None]
        + np.einsum("ij,ij->i", centroids, centroids)[None, :]
        - 2.0 * matrix @ centroids.T
    )
    return np.sqrt(np.maximum(square, 0.0))
