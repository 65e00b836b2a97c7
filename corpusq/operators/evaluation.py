"""Evaluation tables: pair scores, statistics, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions import vectors as vx
from corpusq.session import materialize

def pair_scores(df: DataFrame, a: str, b: str, question: str | None = None, manhattan: bool = False) -> DataFrame:
    """Add the cosine of two vector columns, and of each with the question's;
    if asked for, also the Manhattan distance of the two."""
    scored = df.withColumn("cosine_similarity", vx.cosine(F.col(a), F.col(b)))
    if manhattan:
        scored = scored.withColumn("manhattan_distance", vx.manhattan(F.col(a), F.col(b)))
    if question:
        scored = scored.withColumn("cosine_similarity_question_a", vx.cosine(F.col(a), F.col(question)))
        scored = scored.withColumn("cosine_similarity_question_b", vx.cosine(F.col(b), F.col(question)))
    return scored


def score_stats(df: DataFrame, *columns: str) -> DataFrame:
    """`(column, min, max, mean, n)`, one row per column, from one pass."""
    per_column = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]))
    return df.select(per_column.alias("_c")).groupBy("_c.column").agg(
        F.min("_c.v").alias("min"), F.max("_c.v").alias("max"), F.avg("_c.v").alias("mean"), F.count("_c.v").alias("n")
    )


def _counted(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """`(group.., value, n)`: each value counted, combined before the shuffle, and the narrow table written for the passes
    to come, so that what the column is made of is computed once."""
    value = F.col(column).cast("double").alias("value")
    rows = df.where(F.col(column).isNotNull()).select(*group, value)
    return materialize(rows.groupBy(*group, "value").agg(F.count("*").alias("n")), "values")


def weighted_quantiles(counts: DataFrame, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of a table `(value, n)`, each value counting n times, interpolated between neighbours.

    Values are range-partitioned and sorted; one total per partition comes to the driver, and only partitions that hold
    a wanted rank are summed through. The way is the same for any number of values.
    """
    placed = materialize(
        counts.where("n > 0").orderBy("value").withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()), "quantiles"
    )
    totals = placed.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect()
    total = sum(r["n"] for r in totals)
    if not total:
        return [math.nan for _ in shares]
    wanted = [(total - 1) * p for p in shares]
    ranks = sorted({r for w in wanted for r in (math.floor(w), math.ceil(w))})
    before, found = 0, {}
    for row in totals:
        inside = [r - before for r in ranks if before <= r < before + row["n"]]
        if inside:
            upto = F.sum("n").over(Window.orderBy("_place"))
            running = placed.where(F.col("_part") == row["_part"]).withColumn("_to", upto)
            hit = F.expr(" or ".join(f"(_to - n <= {r} and {r} < _to)" for r in inside))
            for x in running.where(hit).collect():
                found.update({before + r: x["value"] for r in inside if x["_to"] - x["n"] <= r < x["_to"]})
        before += row["n"]
    low = [found[math.floor(w)] for w in wanted]
    high = [found[math.ceil(w)] for w in wanted]
    return [a + (b - a) * (w - math.floor(w)) for a, b, w in zip(low, high, wanted)]


def auto_bins(counts: DataFrame) -> int:
    """Number of bins for a table of `(value, n)`: the larger of Sturges' and
    Freedman-Diaconis' numbers."""
    row = counts.agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if not row["n"] or row["hi"] == row["lo"]:
        return 1
    low, high = weighted_quantiles(counts, (0.25, 0.75))
    span = row["hi"] - row["lo"]
    sturges = span / (math.log2(row["n"]) + 1.0)
    freedman = 2.0 * (high - low) / row["n"] ** (1.0 / 3.0)
    width = min(sturges, freedman) if freedman > 0 else sturges
    return max(1, math.ceil(span / width))


def histogram(df: DataFrame, column: str, bins: int | str = 20, by: str | None = None) -> DataFrame:
    """Equal-width histogram between the smallest and the largest value:
    `([by,] bin, low, high, n)` with bins from 1; the last bin holds its upper
    edge. Bins without rows are left out. With `by`, one histogram per value of
    that column over common edges. `bins='auto'` picks the number from the data.

    Only the two edges come to the driver; counts are combined before the shuffle.
    """
    group = [by] if by else []
    counts = _counted(df, column, group)
    low, high = counts.agg(F.min("value"), F.max("value")).first()
    if low is None:
        low = high = 0.0
    if bins == "auto":
        bins = auto_bins(counts.groupBy("value").agg(F.sum("n").alias("n")) if by else counts)
    if high == low:  # a single value still gets a bin of some width
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    per_bin = counts.groupBy(*group, number.alias("bin")).agg(F.sum("n").alias("n"))
    return per_bin.select(
        *group, "bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"),
        (F.lit(low) + F.col("bin") * width).alias("high"), "n",
    )


# Cells of the grid that values are summed on before the kernel is applied.
GRID = 1 << 16


def density(
    df: DataFrame, column: str, points: Sequence[float] | int = 200, bandwidth: float | None = None, grid: int = GRID
) -> DataFrame:
    """Gaussian kernel density: `(point, density)`.

    `points` are given, or their number between the smallest and the largest
    value. Without a bandwidth Scott's rule is used, from the mean squared distance to the mean; a single value has bandwidth 1.

    Values are binned linearly: each gives its two neighbours on a grid of at most `grid` cells its weight in shares. The sums of the
    cells, which are all that comes to the driver, are convolved with the kernel once. Whole numbers within `grid` of each other lie on the
    grid, and the result is exact; for others no density is off by more than step^2 / (20 * bandwidth^3).
    """
    counts = _counted(df, column)
    row = counts.agg(F.min("value"), F.max("value"), F.sum("n"), F.sum(F.col("n") * F.col("value"))).first()
    low, high, n = row[0] or 0.0, row[1] or 0.0, row[2] or 0
    if isinstance(points, int):
        points = [low + (high - low) * i / max(1, points - 1) for i in range(points)]
    if bandwidth is None:
        mean = row[3] / n if n else 0.0
        squares = counts.agg(F.sum(F.col("n") * (F.col("value") - mean) ** 2)).first()[0] or 0.0
        bandwidth = math.sqrt(squares / (n - 1)) * n ** -0.2 if n > 1 and squares > 0 else 1.0
    whole = isinstance(df.schema[column].dataType, T.IntegralType) and high - low <= grid
    step = 1.0 if whole else (high - low) / grid or 1.0
    place = (F.col("value") - F.lit(low)) / F.lit(step)
    shares = F.array(
        F.struct(F.floor(place).alias("cell"), (F.floor(place) + 1 - place).alias("share")),
        F.struct((F.floor(place) + 1).alias("cell"), (place - F.floor(place)).alias("share")),
    )
    cells = counts.select("n", F.inline(shares)).where("share > 0").groupBy("cell").agg(F.sum(F.col("n") * F.col("share")).alias("weight"))
    held = cells.collect()  # at most `grid` + 1 rows
    at = np.array([low + step * r["cell"] for r in held])
    weight = np.array([r["weight"] for r in held])
    scale = n * float(bandwidth) * math.sqrt(2 * math.pi)
    rows = [(float(p), float((weight * np.exp(-(((p - at) / bandwidth) ** 2) / 2)).sum() / scale)) for p in points] if n else []
    return df.sparkSession.createDataFrame(rows, "point double, density double")


def with_answers(questions: DataFrame, answers: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Questions with the answer columns added; unanswered ones stay with nulls."""
    return questions.join(answers, question_id, "left")
