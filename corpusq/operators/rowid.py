"""Row numbers over a whole table without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row place in the low 33 bits


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = "id", start: int = 1) -> DataFrame:
    """Add `start, start + 1, ...` in the order of `order_by`, which should be total.

    The table is range-partitioned and sorted, written once with each row's
    place in its partition, and only the row counts per partition are gathered
    to get the offsets.
    """
    spark = df.sparkSession
    placed = materialize(df.orderBy(*order_by).withColumn("_place", F.monotonically_increasing_id()), "rowid")
    part = F.shiftrightunsigned("_place", _LOCAL_BITS).cast("int")
    counts = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, total = [], start
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["count"]
    lookup = spark.createDataFrame(offsets, "_part int, _offset bigint")  # one row per partition
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(lookup), "_part")
        .select((F.col("_offset") + local).alias(name), *df.columns)
    )


def with_batches(df: DataFrame, order_by: Sequence[str | Column], size: int = 50) -> DataFrame:
    """Add `batch_id`: rows `0..size-1` in the given order are batch 0, and so on."""
    numbered = with_row_id(df, order_by, "_n", start=0)
    return numbered.select(F.floor(F.col("_n") / size).cast("bigint").alias("batch_id"), *df.columns)
