"""Loading pages into the vector table as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusq.plans import corpus
from corpusq.sources.sinks import append_vectors

KEY = ("page_id", "section_no", "split_id")


def ingest_pages(
    pages: DataFrame, table: str, checkpoint: str, dedupe_key: Sequence[str] | None = KEY,
    exclude: Sequence[str] = corpus.EXCLUDED_SECTIONS, trigger: dict | None = None,
) -> StreamingQuery:
    """Parse, chunk and embed a stream of pages and append them to the vector
    table at `table`. All steps work inside a page row, so no state is kept.
    A batch that runs again after a failure adds nothing twice while
    `dedupe_key` is set."""

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = corpus.vectors(corpus.chunks(corpus.sections(batch, exclude)))
        append_vectors(rows, table, dedupe_key)

    return (
        pages.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
