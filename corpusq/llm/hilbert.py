"""Sharding along a Hilbert curve (DataFrame functions only).

Metadata dimensions are quantised to equal shares of the rows, a curve index orders the cells so that
neighbours on the curve are near in every dimension, and runs of the order become shards. Each shard then covers a small
box of the metadata, and readers prune files by any of the dimensions.

The law is `rows`: with N rows and S shards, row number r (from 0) goes to shard floor(r * S / N), so
counts differ by one at most. A cell with a third of all rows is simply cut by several shards.

Null values of a dimension come before all others. Null ids come first inside a cell; null texts count as empty.
Repeated rows are placed each. An empty table gives an empty result. Extra columns are passed over (`place`) or kept
(`write_shards`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import with_order_number
from corpusq.session import join_small, materialize

BITS = 5
SHARDS = 16


def curve_index(axes: Column, dims: int, bits: int) -> Column:
    """Hilbert index of the integer coordinates in the array `axes` (each below 2**bits), by the published
    transpose method: undo excess work from the highest bit down, Gray-encode, interleave."""

    def get(x: Column, i) -> Column:
        return F.get(x, i if isinstance(i, Column) else F.lit(i))

    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])

    def undo(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        hit = get(x, s["i"]).bitwiseAND(s["q"]) != 0
        swapped = get(x, 0).bitwiseXOR(get(x, s["i"])).bitwiseAND(p)
        change = F.when(hit, p).otherwise(swapped)
        return F.transform(
            x, lambda v, k: F.when(k == 0, v.bitwiseXOR(change)).when((k == s["i"]) & ~hit, v.bitwiseXOR(swapped)).otherwise(v)
        )

    def xor_all(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a.bitwiseXOR(v))

    undone = F.aggregate(steps, axes, undo)
    gray = F.transform(undone, lambda v, k: xor_all(F.slice(undone, F.lit(1), k + 1)))
    high = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    last = F.aggregate(
        high, F.lit(0), lambda t, q: F.when(get(gray, dims - 1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
    )
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])

    return F.aggregate(
        places, F.lit(0).cast("long"),
        lambda a, s: a * 2 + (F.floor(get(gray, s["i"]).bitwiseXOR(last) / F.pow(F.lit(2), s["b"])).cast("long") % 2),
    )


def quantised(values: DataFrame, dim: str, bits: int, rows: int) -> DataFrame:
    """`(dim, bin)`: each distinct value with the part, of 2**bits equal parts of the rows, in which its rows begin.

    Values are counted first (combined before the shuffle), so a frequent value is one row here; the running
    sum over the ordered values is distributed.
    """
    counted = values.groupBy(dim).agg(F.count("*").alias("_rows"))
    summed = with_order_number(counted, [F.col(dim).asc_nulls_first()], {"_rows": F.col("_rows")}, f"bins-{dim}")
    inside = F.sum("_rows").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("_off__rows") + F.coalesce(inside, F.lit(0))
    return summed.select(dim, F.floor(before * (1 << bits) / F.lit(max(rows, 1))).cast("int").alias(f"_bin_{dim}"))


def place(docs: DataFrame, dims: Mapping[str, Column], ties: Sequence[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """`_row` (all columns of `docs`; pass narrow ones where texts are not needed), `curve`, `shard` and `slot`.

    `dims` names the dimensions, `ties` order rows of one cell. Rows are kept as one value, so their columns may have any names; equal
    rows are numbered in the stored copy, so a task that runs again gives them the same places.
    """
    names = {k: f"_d{n}" for n, k in enumerate(dims)}
    order = {f"_t{n}": c for n, c in enumerate(ties)}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = materialize(docs.select(
        row, *[c.alias(names[k]) for k, c in dims.items()], *[c.alias(t) for t, c in order.items()],
        F.monotonically_increasing_id().alias("_tie"),
    ), "dims")
    rows = held.count()
    out = held
    for d in names.values():  # one small join for each dimension
        bins = materialize(quantised(held.select(d), d, bits, rows), "bins").withColumnRenamed(d, "_v")
        out = join_small(out, bins, F.col(d).eqNullSafe(F.col("_v"))).drop("_v", d)
    binned = [f"_bin_{d}" for d in names.values()]
    cells = out.select(*binned).distinct().withColumn("_curve", curve_index(F.array(*binned), len(binned), bits))
    cells = materialize(cells, "cells")  # at most 2**(bits * dims) rows
    curved = join_small(out, cells, binned).select("_row", "_curve", *order, "_tie")
    keys = [F.col("_curve"), *[F.col(t).asc_nulls_first() for t in order], F.col("_tie")]
    ranked = with_order_number(curved, keys, {}, "curve")
    shard = F.floor(F.col("rank") * shards / F.lit(max(rows, 1))).cast("int")
    first = F.floor((shard.cast("long") * rows + shards - 1) / F.lit(shards)).cast("long")
    return ranked.select("_row", F.col("_curve").alias("curve"), shard.alias("shard"), (F.col("rank") - first).alias("slot"))


def document_dims(text: str = "text") -> dict[str, Column]:
    """Source, language and size of a document."""
    return {"source": F.col("source"), "lang": F.col("lang"), "size": size(text)}


def size(text: str = "text") -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select("doc_id", F.col("source"), F.col("lang"), size(text).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}
    placed = place(narrow, dims, [F.col("doc_id"), F.col("text_crc32")], shards, bits)
    return placed.select(
        "_row.doc_id", "_row.size", "_row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, text: str = "text") -> None:
    """Write whole documents as Parquet, one folder `_shard=n` for each shard, rows in curve order, so that the files' column
    statistics prune by source, language and size. All columns of the documents are written, whatever their names."""
    placed = place(docs, document_dims(text), [F.col("doc_id")], shards, bits)
    ordered = placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    ordered.select("_row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
