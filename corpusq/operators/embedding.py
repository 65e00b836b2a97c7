"""Vectors and metadata for chunk rows, and the vector table's own scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions.hooks import default_embed

DIM = 64


def embed(
    df: DataFrame, text: str = "split", embed_hook: Callable[[Column], Column] | None = None, dim: int = DIM,
    name: str = "embedding",
) -> DataFrame:
    """Add the vector of a text column."""
    hook = embed_hook or default_embed(dim)
    return df.withColumn(name, hook(F.col(text)))


def filled(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Columns as text with nulls turned to `''`; columns that cannot be null are kept as they are."""
    chosen = columns or df.columns
    fields = {f.name: f for f in df.schema.fields}
    return [
        F.col(c) if not fields[c].nullable else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in chosen
    ]


def with_metadata(df: DataFrame, columns: Sequence[str], name: str = "metadata") -> DataFrame:
    """Add one struct column with the given columns, nulls filled. A struct lets
    a scan read only the fields a query asks for."""
    return df.withColumn(name, F.struct(*filled(df, columns)))


def metadata_field(field: str, metadata: str = "metadata") -> Column:
    """A field of the metadata struct."""
    return F.col(metadata)[field]


def metadata_variant(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Metadata as a `variant`, for tables whose rows differ in their fields."""
    return df.withColumn(metadata, F.to_variant_object(F.col(metadata)))


def open_metadata(df: DataFrame, columns: Sequence[str], name: str = "metadata") -> DataFrame:
    """Add a `variant` that holds the columns a row has a value for, so rows may differ in their fields."""
    return df.withColumn(name, F.parse_json(F.to_json(F.struct(*columns))))


def variant_field(field: str, kind: str = "string", metadata: str = "metadata") -> Column:
    """A field of `variant` metadata; null where a row does not have it or it is of another type."""
    return F.try_variant_get(F.col(metadata), f"$.{field}", kind)


def check_dimension(vectors: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Fail the job at a vector of another length, as a fixed-size field would."""
    wrong = F.concat(F.lit(f"expected {dim} values, found "), F.size(embedding).cast("string"))
    checked = F.when(F.size(embedding) == dim, F.col(embedding)).otherwise(
        F.raise_error(wrong).cast(T.ArrayType(T.FloatType()))
    )
    return vectors.withColumn(embedding, checked)


def predicate_scan(
    vectors: DataFrame, predicate: str | Column, fields: Sequence[str], limit: int | None, order_by: Sequence[str]
) -> DataFrame:
    """Chosen fields of the first rows, in a stated order, that meet a predicate."""
    found = vectors.where(predicate)
    if limit is not None:
        found = found.orderBy(*order_by).limit(limit)
    return found.select(*fields)
