"""Cutting section texts into chunks under a token limit. Row-local: a section
becomes an array of chunks, then rows; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.hooks import default_tokens
from corpusq.functions.text import clean, drop_numeric_lines, let, sentences, word_count, words

# Token limit and sentences per chunk of the service.
MAX_TOKENS = 512
SENTENCES_PER_CHUNK = 6


def sentence_groups(sents: Column, length: int | Column) -> Column:
    """Consecutive groups of `length` sentences; the last may be shorter."""
    length = F.lit(length) if isinstance(length, int) else length

    def cut(s: Column) -> Column:
        return F.transform(_starts(s, length), lambda i: F.array_join(F.slice(s, i, length), " "))

    return let(sents, cut)


def _starts(items: Column, length: Column) -> Column:
    """Places where groups of `length` items begin; null without items."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), length))


# Sentences of a block: groups are packed inside blocks, and a block hands on the words of its last group.
_BLOCK = 128


def word_groups(sents: Column, length: int) -> Column:
    """Whole sentences packed up to `length` words per group, in order. A
    sentence with more words than that stands alone.

    Openings are gathered block by block, so a text costs time in proportion to its length: within a block a short list grows, and
    between blocks only whole lists are put side by side.
    """

    def pack(counts: Column, at: Column, held: Column) -> Column:
        """Openings among the sentences `at, at + 1, ..` after a group that holds `held` words (below zero: there is none)."""
        start = F.struct(F.array().cast("array<int>").alias("opens"), held.alias("held"), at.alias("pos"))

        def step(acc: Column, n: Column) -> Column:
            fresh = (acc["held"] < 0) | (acc["held"] + n > length)
            return F.struct(
                F.when(fresh, F.concat(acc["opens"], F.array(acc["pos"]))).otherwise(acc["opens"]).alias("opens"),
                F.when(fresh, n).otherwise(acc["held"] + n).alias("held"),
                (acc["pos"] + 1).alias("pos"),
            )

        return F.aggregate(counts, start, step)

    def openings(counts: Column) -> Column:
        start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.lit(-1).alias("held"))

        def step(acc: Column, at: Column) -> Column:
            return let(pack(F.slice(counts, at, _BLOCK), at, acc["held"]), lambda block: F.struct(
                F.concat(acc["done"], F.array(block["opens"])).alias("done"), block["held"].alias("held")
            ))

        starts = F.sequence(F.lit(1), F.greatest(F.size(counts), F.lit(1)), F.lit(_BLOCK))
        return F.aggregate(starts, start, step, lambda acc: F.flatten(acc["done"]))

    def cut(s: Column) -> Column:
        def build(opens: Column) -> Column:
            def group(at: Column, j: Column) -> Column:
                end = F.coalesce(F.try_element_at(opens, j + 2), F.size(s) + 1)
                return F.array_join(F.slice(s, at, end - at), " ")

            return F.transform(opens, group)

        return let(let(F.transform(s, lambda x: F.size(words(x))), openings), build)

    return let(sents, cut)


def split_text(text: Column, split_by: str = "sentence", split_length: int | Column = SENTENCES_PER_CHUNK) -> Column:
    """Array of chunks of one text: drop table-like lines, clean, cut.
    A text with nothing left gives an empty array."""
    if split_by not in ("sentence", "word"):
        raise ValueError(f"split_by must be 'sentence' or 'word', not {split_by!r}")

    def cut(cleaned: Column) -> Column:
        sents = sentences(cleaned)
        groups = sentence_groups(sents, split_length) if split_by == "sentence" else word_groups(sents, split_length)
        return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(groups)

    return let(clean(drop_numeric_lines(text)), cut)


def chunk(
    sections: DataFrame,
    content: str = "content",
    split_by: str = "sentence",
    split_length: int | Column = SENTENCES_PER_CHUNK,
    max_tokens: int | None = MAX_TOKENS,
    tokens: Callable[[Column], Column] | None = None,
    lang: str | None = None,
    valid_languages: tuple[str, ...] | None = None,
) -> DataFrame:
    """Chunk rows: all columns of `sections` plus `split`, `split_id`, `tokens`.

    A text within `max_tokens` is kept as it is with `split_id` 0; a longer one
    is cut. `max_tokens=None` cuts every text. Null texts give no rows. With
    `valid_languages` only rows whose column `lang` holds one of them are used.
    """
    count = tokens or default_tokens()
    text = F.col(content)
    if valid_languages:
        sections = sections.where(F.col(lang).isin(*valid_languages))
    pieces = split_text(text, split_by, split_length)
    if max_tokens is None:
        rows = sections.where(text.isNotNull()).select("*", F.posexplode(pieces).alias("split_id", "split"))
        return rows.withColumn("tokens", count(F.col("split"))).select(
            *sections.columns, "split", "split_id", "tokens"
        )
    counted = sections.where(text.isNotNull()).withColumn("_whole", count(text))
    whole = F.col("_whole") <= max_tokens
    rows = counted.select("*", F.posexplode(F.when(whole, F.array(text)).otherwise(pieces)).alias("split_id", "split"))
    # the count of a whole text is known already
    return rows.withColumn("tokens", F.when(whole, F.col("_whole")).otherwise(count(F.col("split")))).select(
        *sections.columns, "split", "split_id", "tokens"
    )


def rejected(sections: DataFrame, content: str = "content") -> DataFrame:
    """Rows that `chunk` gives nothing for, with the reason."""
    text = F.col(content)
    reason = F.when(text.isNull(), "no text").when(clean(text) == "", "empty text")
    return sections.withColumn("reason", reason).where(F.col("reason").isNotNull())


def chunk_sizes(
    texts: DataFrame, sizes: Sequence[int], content: str = "content",
    tokens: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Token counts of the chunks of every text, cut once per size:
    `split_length`, `split_id`, `tokens` in place of the text.

    A text is read, cleaned and cut into sentences once, whatever the number of
    sizes. Words do not cross sentences, so the default count is taken once per
    sentence and added up; a token hook sees the text of each chunk.
    """
    def cut(cleaned: Column) -> Column:
        return F.when(cleaned != "", sentences(cleaned))

    sents = let(clean(drop_numeric_lines(F.col(content))), cut)
    carried = [c for c in texts.columns if c != content]
    length, items = F.col("split_length"), F.col("_items")

    def add_up(counts: Column) -> Column:
        return F.transform(
            _starts(counts, length), lambda i: F.aggregate(F.slice(counts, i, length), F.lit(0), lambda a, n: a + n)
        )

    cuts = texts.select(*carried, (sents if tokens else F.transform(sents, word_count)).alias("_items"))
    sized = cuts.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("split_length"))
    groups = sentence_groups(items, length) if tokens else let(items, add_up)
    rows = sized.select(*carried, "split_length", F.posexplode(groups).alias("split_id", "tokens"))
    return rows.withColumn("tokens", tokens(F.col("tokens"))) if tokens else rows
