"""Vector functions as Column expressions over `array<float>` columns."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of texts whose words are counted at once; a longer text is counted by itself.
TOGETHER = 4_000_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclid(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_sum(F.zip_with(a, b, square)))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Default text vector: word counts per hash bucket, scaled to length one.
    A text without words gives the zero vector.

    The bucket of a word is the first 32 bits of its MD5, modulo `dim`. Counting
    words into buckets row by row with array functions takes `dim` passes over
    the words; here the texts of an Arrow batch are counted `TOGETHER` bytes at a time and each distinct
    word of them is hashed once.
    """

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return _in_parts(texts, dim)

    return run(F.coalesce(F.lower(text), F.lit("")))


def _in_parts(texts: pa.Array, dim: int, together: int = TOGETHER) -> pa.Array:
    """Words take many times the room of their text while they are counted, so only some of a batch's texts are split at once."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // together
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([_count_words(texts.slice(a, b - a), dim) for a, b in zip(edges, edges[1:])])


def _count_words(texts: pa.Array, dim: int) -> pa.Array:
    for space in "\t\n\r\f":  # one kind of space is split faster than a pattern; empty words have no bucket
        texts = pc.replace_substring(texts, space, " ")
    parts = pc.split_pattern(texts, " ")
    row = pc.list_parent_indices(parts).to_numpy()
    coded = pc.list_flatten(parts).dictionary_encode()
    found = coded.dictionary.cast(pa.binary()).to_pylist()
    first = np.frombuffer(b"".join(md5(w).digest()[:4] for w in found), dtype=">u4").astype(np.int64)
    bucket = np.where(np.array([len(w) > 0 for w in found], dtype=bool), first % dim, -1)
    place = bucket[coded.indices.to_numpy()]
    counts = np.bincount(row[place >= 0] * dim + place[place >= 0], minlength=len(texts) * dim)
    counts = counts.reshape(len(texts), dim).astype(np.float64)
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    vectors = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0).astype(np.float32)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
