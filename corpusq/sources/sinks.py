"""Writing results: files, the vector table, stop words, service records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.embedding import check_dimension
from corpusq.sources.readers import CSV_DIALECT

# A page may repeat a heading, so the section is told by its number.
CHUNK_KEY = ("page_id", "section_no", "split_id")


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder. Null is an empty field, an empty text is `""`."""
    options = {k: v for k, v in CSV_DIALECT.items() if k != "multiLine"}
    (
        df.write.mode("overwrite").options(**options).option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet folder, the form later stages read columns of."""
    df.write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str, group: Column) -> None:
    """JSON record arrays: one file for each value of `group`, which holds as many rows as an array should."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    arrays = df.select(group.alias("_g"), record.alias("_r")).groupBy("_g").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    text = F.concat(F.lit("["), F.array_join("_r", ",\n"), F.lit("]"))
    arrays.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One file for each row, in a folder `name=value`."""
    df.select(name, F.col(text).alias("value")).write.partitionBy(name).text(path)


def create_vector_table(spark: SparkSession, name: str, metadata: str = "string") -> None:
    """Make the vector table if it is not there: key, vector, metadata."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT, embedding ARRAY<FLOAT>, metadata {metadata}) USING parquet"
    )


def drop_vector_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def new_rows(rows: DataFrame, existing: DataFrame, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """Rows whose key is not in `existing` yet. Null key fields equal each other.

    The joined side is only the key. The key has several fields, so a page with
    most of the rows is spread over all join partitions.
    """
    held = existing.select(*[F.col(c).alias(f"_{c}") for c in key])
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(held, on, "left_anti")


def append_vectors(
    rows: DataFrame, path: str, dedupe_key: Sequence[str] | None = None, dim: int | None = None
) -> None:
    """Append rows to a Parquet vector table in one write. As in a plain insert,
    a second run adds the rows again; with `dedupe_key` only new keys are added,
    each once."""
    spark = rows.sparkSession
    if dim is not None:
        rows = check_dimension(rows, dim)
    if dedupe_key:
        rows = rows.dropDuplicates(list(dedupe_key))
        if _exists(spark, path):
            rows = new_rows(rows, spark.read.parquet(path), dedupe_key)
    rows.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def add_stop_words(words: DataFrame, new: DataFrame) -> DataFrame:
    """The list with new words appended; written as a new version by the caller."""
    return words.select("word").unionByName(new.select("word"))


def delete_stop_words(words: DataFrame, removed: DataFrame) -> DataFrame:
    """The list without the given words. Words are compared whole, so removing
    `song` leaves `mysong` alone."""
    return words.select("word").join(removed.select("word"), "word", "left_anti")


def answer_records(answers: DataFrame) -> DataFrame:
    """Answers as JSON text `{answer, urls, titles}`."""
    record = F.to_json(F.struct("answer", "urls", "titles"), {"ignoreNullFields": "false"})
    return answers.select("question_id", record.alias("record"))


def option_records(found: DataFrame) -> DataFrame:
    """Options as JSON texts `{id, text}`, one per row, ready to be streamed
    out as a list of results; the list is not gathered in one value."""
    return found.select(F.to_json(F.struct("id", "text")).alias("record"))
