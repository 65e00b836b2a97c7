"""Chunks at rest: vectors and texts as two tables bucketed alike by the chunk's key.

A search reads vectors only. Its hits then meet the texts bucket by bucket: the hits are dealt out to the texts' buckets, and
no text is moved for the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.answers import HITS, SERVICE_SEPARATOR, gather
from corpusq.operators.search import fits_broadcast, top_k
from corpusq.session import materialize

BUCKETS = 16
TEXTS = ("split", "page_url", "title")


@dataclass(frozen=True)
class ChunkStore:
    """Names of the two tables, and the columns of the key."""

    vector_table: str
    text_table: str
    keys: tuple[str, ...]

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.vector_table)

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.text_table)


def write_chunk_store(
    chunks: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int = BUCKETS, embedding: str = "embedding"
) -> ChunkStore:
    """Write chunks with their vectors as the tables `name_vectors` and `name_texts` in the folder `path`.

    Chunks are dealt out to buckets once and stored; both tables are written from that copy, one file for each bucket.
    """
    keys = list(keys)
    held = materialize(chunks.select(*keys, embedding, *TEXTS).repartition(buckets, *keys), "chunks")
    store = ChunkStore(f"{name}_vectors", f"{name}_texts", tuple(keys))
    for table, columns in ((store.vector_table, [embedding]), (store.text_table, TEXTS)):
        dealt = held.select(*keys, *columns).repartition(buckets, *keys)
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{table}").format("parquet").saveAsTable(table)
    return store


def drop_chunk_store(spark: SparkSession, store: ChunkStore) -> None:
    """Take both tables out of the catalog; their files stay in the folder they were written to."""
    for table in (store.vector_table, store.text_table):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def retrieve_stored(
    questions: DataFrame, store: ChunkStore, k: int = HITS, sep: str = SERVICE_SEPARATOR, question_id: str = "question_id", **search
) -> DataFrame:
    """`answers.retrieve` on stored chunks: `(question_id, question, context, best, urls, titles)`."""
    spark = questions.sparkSession
    keys = list(store.keys)
    small = fits_broadcast(questions)
    hits = materialize(top_k(questions, store.vectors(spark), k, question_id=question_id, keys=keys, small=small, **search), "hits")
    # keys of the search are longs; the join uses the key's own type, so that buckets meet
    texts = store.texts(spark)
    typed = hits.select(*[F.col(c).cast(texts.schema[c].dataType).alias(c) if c in keys else F.col(c) for c in hits.columns])
    return gather(questions, typed, texts, small, sep, keys, question_id)
