"""Substring search by q-grams: a stored posting table for many searches, and a join for a list of words.

A text that holds a term holds all its q-grams. So only texts with the term's rarest grams are looked at, and
`contains` has the last word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.session import join_small, materialize

Q = 3
RAREST = 3  # grams of a term whose postings are intersected
BUCKETS = 32


def grams(text: Column, size: int = Q) -> Column:
    """The distinct substrings of `size` characters; none for shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


# --- stored postings --------------------------------------------------------


@dataclass(frozen=True)
class GramIndex:
    """Postings `(gram, id)` and how many ids each gram has, both partitioned by a bucket of the gram."""

    path: str
    q: int = Q
    buckets: int = BUCKETS

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def create_gram_index(texts: DataFrame, path: str, key: str = "id", text: str = "label", q: int = Q, buckets: int = BUCKETS) -> GramIndex:
    """Write the posting table of `texts`: one row for each text and distinct gram, so linear in the length of the texts."""
    own = texts.select(F.col(key).alias("id"), F.explode(grams(F.col(text), q)).alias("gram")).distinct()
    own = own.withColumn("bucket", _bucket(F.col("gram"), buckets))
    # a frequent gram is dealt to several files of its bucket
    own.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = GramIndex(path, q, buckets)
    spark = texts.sparkSession
    index.postings(spark).groupBy("bucket", "gram").agg(F.count("*").alias("n")).write.partitionBy("bucket").parquet(f"{path}/counts")
    return index


def candidates(index: GramIndex, spark: SparkSession, term: str) -> DataFrame | None:
    """`(id)` of texts that hold the rarest grams of the term. None if the term is too short to have any."""
    pieces = sorted({term[i : i + index.q] for i in range(len(term) - index.q + 1)})
    if not pieces:
        return None
    asked = spark.createDataFrame([(p,) for p in pieces], "gram string").withColumn("bucket", _bucket(F.col("gram"), index.buckets))
    where = {r["gram"]: r["bucket"] for r in asked.collect()}  # one row for each gram of the term

    def chosen(df: DataFrame, some: Sequence[str]) -> DataFrame:
        return df.where(F.col("bucket").isin(sorted({where[g] for g in some})) & F.col("gram").isin(list(some)))

    held = {r["gram"]: r["n"] for r in chosen(index.counts(spark), pieces).collect()}
    rarest = sorted(pieces, key=lambda g: (held.get(g, 0), g))[:RAREST]
    found = chosen(index.postings(spark), rarest).groupBy("id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(rarest)).select("id")


# --- a list of words --------------------------------------------------------


def texts_with_words(texts: DataFrame, words: DataFrame, q: int = Q) -> DataFrame:
    """The distinct texts (one column) that contain some of the words (one column, not empty).

    Each word is looked up by one gram, the one that the fewest texts hold; a word shorter than `q` is its own gram. A text gives one
    row for each distinct gram that some word has, so rows are linear in the length of the texts, whatever the words' lengths.
    """
    text, word = texts.columns[0], words.columns[0]
    sizes = [r[0] for r in words.select(F.least(F.length(word), F.lit(q)).alias("n")).distinct().collect()]  # at most q numbers
    if not sizes:
        return texts.where(F.lit(False))

    def gram_list(c: str) -> Column:
        return F.flatten(F.array(*[grams(F.col(c), n) for n in sorted(sizes)]))

    own = F.when(F.length(word) >= q, grams(F.col(word), q)).otherwise(F.array(F.col(word)))
    of_words = words.select(F.col(word).alias("_word"), F.explode(own).alias("_gram"))
    wanted = materialize(of_words.select("_gram").distinct(), "grams")
    distinct = texts.select(F.col(text).alias("_text")).distinct()
    rows = distinct.select("_text", F.explode(gram_list("_text")).alias("_gram"))
    held = materialize(join_small(rows, wanted, "_gram"), "held")
    counts = held.groupBy("_gram").agg(F.count("*").alias("n"))
    ranked = of_words.join(counts, "_gram").groupBy("_word").agg(
        F.count("*").alias("there"), F.min(F.struct("n", "_gram")).alias("rarest")
    )
    # a word with a gram that no text holds is in no text
    sized = words.select(F.col(word).alias("_word"), F.size(own).alias("all"))
    keys = ranked.join(sized, "_word").where("there = all").select("_word", F.col("rarest._gram").alias("_gram"))
    hit = join_small(held, keys, "_gram").where(F.contains(F.col("_text"), F.col("_word")))
    return hit.select(F.col("_text").alias(text)).distinct()
