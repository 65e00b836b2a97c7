"""The vector table with keyed loads.

A table is a folder: `rows`, partitioned by a bucket of the key and by batch, and `commits`, one row for each finished load. A load reads
the keys of its own buckets only, writes its own partitions only, and counts once its commit is there. Run again, it
writes the same partitions again, so a load that failed half-way, or ran twice, does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusq.operators.embedding import check_dimension
from corpusq.session import materialize
from corpusq.sources.sinks import CHUNK_KEY

BUCKETS = 64
PARTS = 64  # tasks that share a bucket of a load at most
_COMMITS = "batch_id string, buckets array<int>, given bigint, added bigint"


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(buckets)).cast("int")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Finished loads: `(batch_id, buckets, given, added)`; none for a folder without a table."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], _COMMITS)


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of finished loads, with `bucket` and `batch_id`."""
    reader = spark.read.schema(schema) if schema else spark.read
    done = commits(spark, path).where("added > 0").select("batch_id").distinct()
    return reader.parquet(f"{path}/rows").join(F.broadcast(done), "batch_id", "left_semi")  # one row for each load


def load_batch(
    rows: DataFrame, path: str, batch_id: str, key: Sequence[str] = CHUNK_KEY, buckets: int = BUCKETS, dim: int | None = None
) -> None:
    """Add the rows whose key is not in the table yet, each key once, as the load `batch_id`.

    Null key fields equal each other. Of rows with the same key in one load the smallest in the order of all
    columns is taken, so a rerun takes the same one. A load that has been committed under this name is replaced by the new one,
    wherever it has rows.
    """
    spark = rows.sparkSession
    if dim is not None:
        rows = check_dimension(rows, dim)
    names = [c for c in rows.columns if c not in key]
    if {"bucket", "batch_id"} & set(rows.columns):
        raise ValueError("`bucket` and `batch_id` are columns of the table itself")
    # rows are computed once; after that they move once, to where their key's rows and bucket are
    batch = materialize(rows.withColumn("bucket", bucket_of(key, buckets)), "batch", "zstd")
    touched = batch.groupBy("bucket").agg(F.count("*").alias("given")).collect()  # at most one row for each bucket
    own = sorted(r["bucket"] for r in touched)
    given = batch.select(*key, "bucket", F.struct(*[F.col(c) for c in names]).alias("_row"), F.lit(False).alias("_held"))
    others = commits(spark, path).where((F.col("batch_id") != batch_id) & (F.col("added") > 0)).select("batch_id").distinct()
    if own and not others.isEmpty():
        schema = batch.withColumn("batch_id", F.lit("")).schema
        held = (
            spark.read.schema(schema).parquet(f"{path}/rows")  # no footer is read for it
            .where(F.col("bucket").isin(own))
            .join(F.broadcast(others), "batch_id", "left_semi")
        )
        none = F.lit(None).cast(given.schema["_row"].dataType)
        given = given.unionByName(held.select(*key, "bucket", none.alias("_row"), F.lit(True).alias("_held")))
    # a bucket is dealt to a few tasks by a part of its key, so that a task writes few buckets
    part = F.pmod(F.hash(*key), F.lit(PARTS))
    moved = given.withColumn("_part", part).repartition("bucket", "_part")
    first = moved.groupBy("bucket", "_part", *key).agg(F.min("_row").alias("_row"), F.max("_held").alias("_held"))
    counted = Observation()
    new = first.where(~F.col("_held")).select(*key, "_row.*", "bucket", F.lit(batch_id).alias("batch_id"))
    (
        new.observe(counted, F.count(F.lit(1)).alias("added")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy("bucket", "batch_id").parquet(f"{path}/rows")
    )
    record = [(batch_id, own, sum(r["given"] for r in touched), counted.get["added"] if own else 0)]
    spark.createDataFrame(record, _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the rows of all loads to a new table as one load, with one file set for each bucket."""
    rows = read_rows(spark, path).withColumn("batch_id", F.lit("compacted"))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket", "batch_id").parquet(f"{target}/rows")
    done = commits(spark, path).agg(
        F.lit("compacted").alias("batch_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("buckets")))).alias("buckets"),
        F.sum("given").alias("given"),
    )
    written = spark.read.parquet(f"{target}/rows").count()
    done.withColumn("added", F.lit(written).cast("bigint")).write.parquet(f"{target}/commits")
