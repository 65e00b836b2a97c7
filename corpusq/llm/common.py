"""What several operators share: the word split, table reading, running totals, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.session import materialize

# White space of all word splits: [\x20\x09-\x0D].
SPACES = ("\n", "\t", "\x0b", "\x0c", "\r")
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row place in the low 33 bits


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    """Every white space character of the word split as a plain space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order. Splitting at one plain character needs no regex engine."""
    return F.array_remove(F.split(one_space(text), " "), "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for the row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_order_number(df: DataFrame, keys: list[Column], weights: dict[str, Column], name: str) -> DataFrame:
    """Give each row its place (`rank`, from 0) in the order of `keys`, and for each
    weight the sum over all earlier rows.

    The rows (keep them narrow) are range-partitioned and sorted, written once to the shared folder with
    the place inside their partition, and only totals per partition (one row for each
    shuffle partition) are summed to offsets. Make the keys unique: then no
    key, however frequent, has to stay in one partition.
    """
    spark = df.sparkSession
    placed = materialize(df.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_place", _LOCAL_BITS).cast("int")
    totals = placed.groupBy(part.alias("_part")).agg(
        F.count("*").alias("rank"), *[F.sum(w).cast("long").alias(k) for k, w in weights.items()]
    )
    sums, offsets = {k: 0 for k in ("rank", *weights)}, []
    for row in sorted(totals.collect(), key=lambda r: r["_part"]):
        offsets.append((row["_part"], *sums.values()))
        sums = {k: v + (row[k] or 0) for k, v in sums.items()}
    lookup = spark.createDataFrame(offsets, "_part int, " + ", ".join(f"_off_{k} long" for k in sums))
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part).join(F.broadcast(lookup), "_part")
        .select(*df.columns, (F.col("_off_rank") + local).alias("rank"), "_part", "_place",
                *[F.col(f"_off_{k}") for k in weights])
    )


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `links (a long, b long)`: `(node, root)`, root the smallest node reachable.

    Alternating large-star and small-star steps: each keeps every component
    connected while all nodes move to smaller neighbours, so a long chain needs few rounds. A star centre with many leaves
    is only ever the key of a minimum, which is pre-aggregated before its shuffle; the join back
    is an equi-join that AQE splits when one centre is hot. Each round is written to
    the shared folder, so lineage stays short and lost executors cost one round.
    """
    edges = materialize(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    state = None
    while True:
        # large star: neighbours above a node point to the smallest of the node's neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours below a node and the node itself point to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:  # nothing moves: only stars are left
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
