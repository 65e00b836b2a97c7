"""Corpus build: categories to pages, pages to sections, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from corpusq.operators.chunking import MAX_TOKENS, SENTENCES_PER_CHUNK, chunk
from corpusq.operators.embedding import DIM, embed, with_metadata
from corpusq.operators.graph import Triples, category_pages, expand
from corpusq.operators.sections import EXCLUDED_SECTIONS, parse_sections, with_revision_times
from corpusq.session import join_small, materialize

METADATA = (
    "page_url", "title", "creation_date", "section", "subsection", "page_id", "last_modified",
    "split", "split_id", "tokens",
)


def selected_pages(
    triples: DataFrame | Triples, roots: DataFrame, depth: int, texts: DataFrame, bounds: DataFrame,
    stop_words: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda pages: pages,
) -> DataFrame:
    """Pages under the roots with text and revision times:
    `(page_id, page_url, creation_date, last_modified, title, content)`.

    Page ids are known and stored before any text is touched; only those that have a text meet urls and times. Texts
    meet them as they lie, and what has to be done to a text (`prepare`) is done for pages that stay."""
    with_text = materialize(texts.select("page_id").where("page_id is not null").distinct(), "text-ids")
    categories = expand(triples, roots, depth, stop_words, named=False).select("category")
    found = category_pages(triples, categories, named=False, only=with_text)
    pages = materialize(with_revision_times(found, bounds), "page-ids")
    return prepare(join_small(texts, pages, "page_id"))


def sections(pages: DataFrame, exclude: Sequence[str] = EXCLUDED_SECTIONS) -> DataFrame:
    return parse_sections(pages, exclude=exclude).select(
        "page_url", "title", "creation_date", "section_no", "section", "subsection", "content", "page_id",
        "last_modified",
    )


def chunks(
    section_rows: DataFrame, split_length: int = SENTENCES_PER_CHUNK, max_tokens: int | None = MAX_TOKENS,
    tokens: Callable[[Column], Column] | None = None,
) -> DataFrame:
    return chunk(section_rows, split_length=split_length, max_tokens=max_tokens, tokens=tokens)


def vectors(
    chunk_rows: DataFrame, embed_hook: Callable[[Column], Column] | None = None, dim: int = DIM,
    keys: Sequence[str] = ("page_id", "section_no", "split_id"),
) -> DataFrame:
    """Keys, vector and metadata struct of each chunk. No shuffle from the page
    text to here, so a stream of pages can go through the same functions."""
    named = with_metadata(chunk_rows, METADATA)
    return embed(named, "split", embed_hook, dim).select(*keys, "embedding", "metadata")
