"""Reading the inputs of the corpus: tables, texts, saved service responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION_SCHEMA = (
    "page_url string, title string, creation_date timestamp_ntz, section string, subsection string, "
    "content string, page_id bigint, last_modified timestamp_ntz"
)
CHUNK_SCHEMA = "id bigint, " + SECTION_SCHEMA + ", split string, split_id int, tokens int"
QUESTION_SCHEMA = "question string, answer string"
ANSWER_PAIR_SCHEMA = "question string, answer_wikipedia string, answer_bard string"

_BINDINGS = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
_REVISIONS = "struct<query:struct<pages:map<string,struct<revisions:array<struct<timestamp:string>>>>>>"

# One CSV dialect for reading and writing, so that texts with quotes, commas,
# line ends and backslashes come back as they were.
# An empty field is null, a quoted empty one is an empty text.
CSV_DIALECT = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "lineSep": "\n"}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a stated schema. A missing path or a malformed row fails the job."""
    return (
        spark.read.schema(schema).options(**CSV_DIALECT).option("mode", "FAILFAST").option("nullValue", "\0")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def read_records(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON records: one array per file, or with `lines` one record per line,
    the form in which large files can be split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Stop words, each ended by `;`."""
    return stop_words(spark.read.text(path), "value")


def stop_words(lines: DataFrame, column: str) -> DataFrame:
    """Stop words of a column of `word;word;` texts."""
    word = F.trim("word")
    return lines.select(F.explode(F.split(column, ";", -1)).alias("word")).select(word.alias("word")).where(word != "")


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files as documents: `(path, content)`. `path` may be one file or a folder."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def read_vectors(spark: SparkSession, name: str) -> DataFrame:
    """A vector table, by catalog name or by Parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def bindings(responses: DataFrame, column: str, *variables: str) -> DataFrame:
    """One row per binding of saved query responses, one column per variable;
    other columns are carried along."""
    parsed = F.from_json(F.col(column), _BINDINGS)["results"]["bindings"]
    carried = [c for c in responses.columns if c != column]
    rows = responses.select(*carried, F.explode(parsed).alias("_b"))
    return rows.select(*carried, *[F.col("_b")[v]["value"].alias(v) for v in variables])


def _revisions(response: Column, page_id: Column) -> Column:
    pages = F.from_json(response, _REVISIONS)["query"]["pages"]
    return F.try_element_at(pages, page_id.cast("string"))["revisions"]


def revision_times(responses: DataFrame, column: str, page_id: str = "page_id") -> DataFrame:
    """`(page_id, creation_date, last_modified)` from saved revision responses,
    newest revision first. Responses without revisions for their page drop out."""
    listed = responses.select(F.col(page_id).alias("page_id"), _revisions(F.col(column), F.col(page_id)).alias("_r"))

    def time(at: int) -> Column:
        return F.try_element_at("_r", F.lit(at))["timestamp"].try_cast("timestamp_ntz")

    return listed.where(F.size("_r") > 0).select(
        "page_id", time(-1).alias("creation_date"), time(1).alias("last_modified")
    )


def revision_rows(responses: DataFrame, column: str, page_id: str = "page_id") -> DataFrame:
    """All revisions as rows `(page_id, ts)`, for pages whose history comes in several responses."""
    listed = responses.select(
        F.col(page_id).alias("page_id"), F.explode(_revisions(F.col(column), F.col(page_id))).alias("_r")
    )
    return listed.select("page_id", F.col("_r")["timestamp"].try_cast("timestamp_ntz").alias("ts"))


def rejected_responses(responses: DataFrame, column: str, page_id: str = "page_id") -> DataFrame:
    """Responses that give no revision times, with the reason."""
    listed = F.size(F.coalesce(_revisions(F.col(column), F.col(page_id)), F.array()))
    reason = F.when(F.from_json(F.col(column), _REVISIONS)["query"].isNull(), "not a revision response").when(
        listed == 0, "no revisions for the page"
    )
    return responses.withColumn("reason", reason).where(F.col("reason").isNotNull())
