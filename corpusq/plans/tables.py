"""The relations the registered queries work on, derived from the driver tables.

Categories are regions, nations, customers, suppliers and parts; orders are
pages. A document is the text of the page with its number, an event is a
revision of the page of its user, benchmark items are questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators import graph
from corpusq.operators.chunking import chunk
from corpusq.operators.embedding import embed
from corpusq.operators.triple_store import GraphStore, build_store
from corpusq.session import join_small, scratch_path, spread
from corpusq.sources.readers import stop_words

SITE = "https://corpus.example/wiki/"
# Headings of the derived markup that are left out, besides the usual ones.
LEFT_OUT = (" As. ", " Le. ", " Is. ", " See also ", " References ", " External links ")


# Stated, so that no job reads footers to find them out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_TRIPLES = f"""
WITH ids AS (
  SELECT 'Category:' || r_name AS s FROM {{region}}
  UNION ALL SELECT 'Category:' || n_name FROM {{nation}}
  UNION ALL SELECT 'Category:' || c_name FROM {{customer}}
  UNION ALL SELECT 'Category:' || s_name FROM {{supplier}}
  UNION ALL SELECT 'Category:Part ' || p_partkey FROM {{part}}
),
labels AS (
  SELECT 'Category:' || r_name AS s, r_name AS o, 'en' AS lang FROM {{region}}
  UNION ALL SELECT 'Category:' || n_name, n_name, 'en' FROM {{nation}}
  UNION ALL SELECT 'Category:' || n_name, n_name || ' nation', 'en' FROM {{nation}}
  UNION ALL SELECT 'Category:' || n_name, n_name || ' Land', 'de' FROM {{nation}}
  UNION ALL SELECT 'Category:' || c_name, c_name || ' ' || lower(c_mktsegment), 'en' FROM {{customer}}
  UNION ALL SELECT 'Category:' || s_name, s_name || ' ' || p_name, 'en' FROM {{supplier}} JOIN {{part}} ON s_suppkey = p_partkey
  UNION ALL SELECT 'Category:Part ' || p_partkey, p_name, 'en' FROM {{part}}
),
broader AS (
  SELECT 'Category:' || n_name AS s, 'Category:' || r_name AS o FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Category:' || c_name, 'Category:' || n_name FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Category:' || s_name, 'Category:' || n_name FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Category:Part ' || l_partkey, 'Category:' || s_name
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {{lineitem}}) JOIN {{supplier}} ON l_suppkey = s_suppkey
),
subjects AS (
  SELECT 'Order_' || o_orderkey AS s, 'Category:' || c_name AS o FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
  UNION ALL SELECT 'Order_' || l_orderkey, 'Category:Part ' || l_partkey
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {{lineitem}})
)
SELECT s, '{graph.TYPE}' AS p, '{graph.CONCEPT}' AS o, CAST(NULL AS string) AS lang FROM ids
UNION ALL SELECT s, '{graph.LABEL}', o, lang FROM labels
UNION ALL SELECT s, '{graph.BROADER}', o, NULL FROM broader
UNION ALL SELECT s, '{graph.SUBJECT}', o, NULL FROM subjects
UNION ALL SELECT 'Order_' || o_orderkey, '{graph.TOPIC_OF}', '{SITE}Order_' || o_orderkey, NULL FROM {{orders}}
UNION ALL SELECT 'Order_' || o_orderkey, '{graph.PAGE_ID}', CAST(o_orderkey AS string), NULL FROM {{orders}}
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category graph as `(s, p, o, lang)`."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return spark.sql(_TRIPLES, **{name: table(spark, sf_dir, name) for name in names})


# Stores built so far in this process: (session, data folder) to store.
_STORES: dict[tuple[str, str], GraphStore] = {}


def graph_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The category graph as a stored graph, built once for a session and its data."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = build_store(triples(spark, sf_dir), scratch_path(spark, "graph"), by_subject=False)
    return _STORES[key]


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(page_id, ts)`: a page changes when its order is placed and when its items are sent, so every page has revisions."""
    placed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderdate").alias("ts"))
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_shipdate").alias("ts"))
    return placed.unionByName(sent)


def _category(name: Column | str) -> Column:
    return F.concat(F.lit("Category:"), name)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(_category(F.col("r_name")).alias("category"))


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part names, read as stop-word lines."""
    lines = table(spark, sf_dir, "part").select(
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" ; ")), F.lit(";")).alias("value")
    )
    return stop_words(lines, "value")


def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-name words that are rarer than the average word; the stop words."""
    counts = part_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n")).first()[0]
    return counts.where(F.col("n") < mean).select("word")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def markup(text: Column) -> Column:
    """Lines of one word become section headings, lines of two words subsections."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^(\S+)$", "== $1 =="), r"(?m)^(\S+ \S+)$", "=== $1 ===")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(page_id, title, content)`."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("page_id"),
        F.concat("source", F.lit(" "), "lang").alias("title"),
        markup(F.col("text")).alias("content"),
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(page_id, title, content)` with the text as it lies; `marked` turns it into markup."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat("source", F.lit(" "), "lang").alias("title"), F.col("text").alias("content")
    )


def marked(pages: DataFrame) -> DataFrame:
    return spread(pages).withColumn("content", markup(F.col("content")))


def web_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(page_id, url, content)`: web pages turned into the same markup."""
    text = F.col("html")
    for found, wanted in (
        (r"<h1>([^<]*)</h1>", "\n== $1 ==\n"),
        (r"<li><a[^>]*>([^<]*)</a></li>", "\n=== $1 ===\n"),
        (r"</?p>|<br>", "\n"),
        (r"<[^>]*>", ""),
    ):
        text = F.regexp_replace(text, found, wanted)
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", text.alias("content"))


def document_chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Chunks of the documents: `(doc_id, split_id, split, tokens, page_url, title)`.
    `only` is a small table whose `doc_id`s are wanted; other texts are not cut."""
    rows = documents(spark, sf_dir)
    if only is not None:
        rows = join_small(table(spark, sf_dir, "documents"), only.select("doc_id"), "doc_id", "left_semi")
    texts = rows.select(
        "doc_id",
        F.col("text").alias("content"),
        F.concat(F.lit(SITE), F.lit("Order_"), F.col("doc_id").cast("string")).alias("page_url"),
        F.concat("source", F.lit(" "), "lang").alias("title"),
    )
    return chunk(texts).drop("content")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(document_chunks(spark, sf_dir)).select("doc_id", "split_id", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(question_id, question, embedding)`."""
    bank = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
    return embed(bank, "question")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: `(conv_id, turn, question, reply)`.

    An equi-join on (conversation, turn), so a long conversation is spread over
    the join partitions; a window over it would be one task."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(reply, ["conv_id", "turn"])
