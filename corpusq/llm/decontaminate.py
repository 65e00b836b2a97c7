"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed is a window of words of which a fixed mask looks at some and ignores the others, so a
replaced word spoils only the seeds that look at it. Each item has the seeds of one mask, chosen by its size. Seeds of all benchmark items and all documents are joined by hash. A hit
gives a diagonal (place in the document less place in the item). On each diagonal the item's words are compared with the
document's, and the diagonal is an overlap if some `WINDOW` consecutive words (or the whole item, if shorter) differ in
at most `SUBSTITUTED` places.

Words are runs of letters and digits in lower case, so changed case, punctuation and marks between words hide nothing.
The tolerance shrinks with the item: of `SHORT` to `SPAN - 1` words one may be replaced (their masks each ignore a third of the
item), of fewer none (the whole item is their seed, and its first place in a text stands for all). A word that is missing at an
edge of the text counts as replaced. Null and empty texts match nothing. Null ids
are reported like others. Rows with the same id and item give one result row, the best. Empty tables give an empty result.
Extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.session import join_small, materialize

# Fixed values, found by enumeration: however `SUBSTITUTED` words are replaced in `WINDOW` words, some shift of the first mask
# looks at none of them; so does the second for items of `SPAN` to `WINDOW - 1` words. The tests enumerate all cases.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 4))
SHORT = 5
SPAN = 11
WINDOW = 13
SUBSTITUTED = 2


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a whole text, in order."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def masks_of(size: int) -> dict[int, tuple[int, ...]]:
    """The masks of items of so many words, by number: one for long items, three for short ones, the whole of the shortest."""
    if size >= WINDOW:
        return {0: MASKS[0]}
    if size >= SPAN:
        return {1: MASKS[1]}
    if size >= SHORT:
        return {10 * size + third: tuple(i for i in range(size) if 3 * i // size != third) for third in range(3)}
    return {-size: tuple(range(size))}


def _seed_rows(df: DataFrame, masks: dict[int, tuple[int, ...]], *keys: str, only: dict[int, Column] | None = None) -> DataFrame:
    """`keys`, `at` (word place) and `seed`, one row for each of `masks` and place; with `only`, where a mask's condition holds."""
    h = F.col("h")

    def masked(n: int, mask: tuple[int, ...]) -> Column:
        places = F.size(h) - mask[-1]
        seeds = F.transform(
            F.sequence(F.lit(0), places - 1),
            lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), *[F.get(h, i + k) for k in mask]).alias("seed")),
        )
        wanted = places > 0 if only is None else (places > 0) & only[n]
        return F.when(wanted, seeds).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    if not masks:
        return df.select(*keys, F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed")).limit(0)
    return df.select(*keys, F.inline(F.concat(*[masked(n, mask) for n, mask in masks.items()])))


def diagonals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct `(_n, item, diagonal, size)` of rows numbered `_n` and items with at least one seed in common; of items
    without tolerance the first place in a row only.

    The benchmark's seeds are broadcast if they are few enough; else the join shuffles seeds, and AQE splits
    frequent ones. Hits are made distinct per task before they are shuffled.
    """
    size = F.col("size")
    sizes = items.select(F.least(size, F.lit(WINDOW)).alias("n")).distinct().collect()  # at most WINDOW numbers
    masks: dict[int, tuple[int, ...]] = {}
    only: dict[int, Column] = {}
    for row in sorted(sizes):  # documents need no other masks
        for n, mask in masks_of(row["n"]).items():
            masks[n] = mask
            here = size >= WINDOW if row["n"] >= WINDOW else size == row["n"]
            only[n] = only[n] | here if n in only else here
    asked = _seed_rows(items, masks, "item", "size", only=only).withColumnRenamed("at", "item_at").distinct()
    hits = join_small(_seed_rows(docs, masks, "_n"), materialize(asked, "seeds"), "seed")
    place = F.col("at") - F.col("item_at")
    kept = F.when(size >= SHORT, place)  # whole items: one place for each row
    return hits.groupBy("_n", "item", "size", kept.alias("kept")).agg(F.min(place).alias("diagonal")).drop("kept")


def _found(texts: DataFrame, benchmark: DataFrame, item_text: str) -> DataFrame:
    """Every overlap of the stored rows `texts (_n, doc_id, _t)`, one row for each diagonal."""
    items = benchmark.select("item_id", word_hashes(F.col(item_text)).alias("h")).withColumn("size", F.size("h"))
    numbered = items.where(F.col("size") > 0).withColumn("item", F.monotonically_increasing_id())
    items = materialize(numbered, "items")  # numbered, because ids may be null or repeated
    hits = materialize(diagonals(texts.select("_n", word_hashes(F.col("_t")).alias("h")), items), "diagonals")
    # words of hit rows only, hashed once; then a row for each hit
    held = join_small(texts, materialize(hits.select("_n").distinct(), "hit-rows"), "_n", "left_semi")
    words = materialize(held.select("_n", "doc_id", word_hashes(F.col("_t")).alias("words")), "hit-words")
    start = F.greatest(F.lit(0).cast("long"), F.col("diagonal")).cast("int")
    size = F.greatest(F.lit(0), (F.col("diagonal") + F.col("size") - start).cast("int"))
    candidates = join_small(words, hits, "_n").select(
        "_n", "doc_id", "item", F.col("diagonal").alias("doc_at"), (start - F.col("diagonal")).cast("int").alias("skip"),
        F.slice("words", start + 1, size).alias("part"),
    )
    met = join_small(candidates, items, "item")
    equal = F.transform("h", lambda x, j: F.coalesce((x == F.get("part", j - F.col("skip"))).cast("int"), F.lit(0)))
    compared = met.select("_n", "doc_id", "item_id", "doc_at", F.col("size").alias("item_words"), equal.alias("equal"))
    wide = F.least(F.lit(WINDOW), F.col("item_words"))
    sums = F.transform(
        F.sequence(F.lit(1), F.col("item_words") - wide + 1),
        lambda i: F.aggregate(F.slice("equal", i, wide), F.lit(0), lambda a, x: a + x),
    )
    scored = compared.select(
        "_n", "doc_id", "item_id", "doc_at", "item_words", wide.alias("wide"),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("matched"), F.array_max(sums).alias("longest"),
    )
    replaced = F.when(F.col("item_words") >= SPAN, SUBSTITUTED).when(F.col("item_words") >= SHORT, 1).otherwise(0)
    return scored.where(F.col("longest") >= F.col("wide") - replaced)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text"
) -> DataFrame:
    """Documents that hold benchmark text: doc_id, item_id, item_words, matched (equal words of the best diagonal),
    longest (most equal words of its windows) and doc_at (word place in the document where the item would start).

    Rows are numbered in a stored copy, so rows with the same id, or none, are searched apart."""
    texts = docs.select(F.monotonically_increasing_id().alias("_n"), "doc_id", F.col(text).alias("_t"))
    real = _found(materialize(texts, "texts"), benchmark, item_text)
    best = F.max(F.struct("longest", "matched", (-F.col("doc_at")).alias("back"), "item_words")).alias("b")
    return real.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.item_words").cast("long").alias("item_words"),
        F.col("b.matched").cast("long").alias("matched"), F.col("b.longest").cast("long").alias("longest"),
        (-F.col("b.back")).cast("long").alias("doc_at"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that hold no benchmark text. Rows are numbered in a stored copy: a row does
    not go with another one of its id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = materialize(docs.select(F.monotonically_increasing_id().alias("_n"), row), "numbered")
    texts = held.select("_n", F.col("_row.doc_id").alias("doc_id"), F.col(f"_row.`{text}`").alias("_t"))
    found = _found(texts, benchmark, "text").select("_n").distinct()
    return join_small(held, materialize(found, "leaks"), "_n", "left_anti").select("_row.*")
