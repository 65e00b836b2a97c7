"""Session defaults and the two helpers every multi-pass operator needs:
writing an intermediate table to the shared folder, and checking a size
before anything is broadcast."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast. The relations that
# go through `join_small` are narrow (ids and short strings), so 200,000 rows
# stay in the tens of megabytes.
BROADCAST_ROWS = 200_000

# Rows of a side with one row for each key that a task may hold in a hash table; beyond that both sides are sorted and merged.
HASHED_ROWS_PER_TASK = 2_000_000


def build_session(app_name: str = "corpusq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE picks join strategies and partition counts from run-time sizes and
    splits skewed join partitions, so the initial partition number can be
    generous on a cluster (`spark.sql.shuffle.partitions`).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`.

    A temporary folder is used only when the setting is absent and the
    session runs on the local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusq-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Lists that collect the scratch paths made while a `scratch_scope` is open.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/corpusq/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths made inside. Pass them to `release` once nothing reads them any more."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()  # scopes close in the order opposite to opening


def release(paths: list[str]) -> None:
    """Delete scratch folders and empty the list. On a store that Arrow cannot open they stay, to be
    removed with the shared folder."""
    from pyarrow import ArrowException, fs

    for path in paths:
        try:
            store, place = fs.FileSystem.from_uri(path)
            if store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_dir(place)
        except (ArrowException, OSError):
            continue
    paths.clear()


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder, read it back.

    Lost executors cannot take the rows with them, later passes read the same
    rows, and the copy is still columnar, so pruning works on it. A `compression` is named
    for large copies that no join reads whole: joins judge a side by the size of its files.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more than `rows` rows; reads at most one row more."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join with a side that is usually small. It is broadcast only if its row
    count, checked here unless the caller has done so, is within
    `BROADCAST_ROWS`; beyond that the join is left to AQE (sort-merge, with
    skewed partitions split)."""
    if small is None:
        small = at_most(right, BROADCAST_ROWS)
    return left.join(F.broadcast(right) if small else right, on, how)


def join_unique(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    """Join with a stored side of `rows` rows that holds a key about once. It is broadcast within `BROADCAST_ROWS`. Beyond
    that a task looks keys up in a hash table of its share, so the other side is not sorted (names sort slowly, as most begin
    alike) and skewed partitions of it are still split. Shares that are too large for this are left to AQE (sort-merge)."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    elif rows <= HASHED_ROWS_PER_TASK * tasks:
        right = right.hint("shuffle_hash")
    return left.join(right, on)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small input to all cores before row-local text work.

    An input that the cores would read in less than one wave of splits (few
    files, or one big row group) keeps most of them idle, so its rows are moved
    once. A larger input is left where it lies: no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB")
    )
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per session. The
    archive is built on the driver and copied to the executors by Spark."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusq_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='corpusq-')}/corpusq", "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sc._corpusq_shipped = True
