"""A stored graph of numbers: names are written once, edges are pairs of longs in two sort orders.

A store is a folder with `terms (id, term)`, numbered in the order of the names, so that the one sorted table finds
names by id and ids by name; `edges`, parted into broader and subject ones, once sorted by subject and once by object; `labels`,
`concepts` and page tables sorted by id. Joins along the graph move longs; names are joined to results only.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.grams import GramIndex, create_gram_index
from corpusq.operators.graph import BROADER, CONCEPT, LABEL, PAGE_ID, SUBJECT, TOPIC_OF, TYPE, Triples
from corpusq.operators.rowid import with_row_id
from corpusq.session import BROADCAST_ROWS, join_small, join_unique, materialize, scratch_path

# Keys that are put into the file filter as literals, so that files and row groups without them are not read.
LITERAL_KEYS = 500


def _sorted(df: DataFrame, path: str, *by: str, parts: Sequence[str] = ()) -> None:
    """Written in ranges of `by`, so that file statistics tell which files hold a key. `parts` become folders."""
    order = [*parts, *by]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*parts).parquet(path)


def _numbered(rows: DataFrame, terms: DataFrame, count: int, name: str, key: str) -> DataFrame:
    """`rows` with the number of the name as `key` instead of `name`."""
    return join_unique(rows, terms.select(F.col("id").alias(key), F.col("term").alias(name)), name, count).drop(name)


def _hash(name: str) -> Column:
    return F.xxhash64(name)


def _hashed(name: str, wanted: bool) -> Column:
    """What names are looked up by: their hash where it is `wanted`, else the name itself. Nulls stay null."""
    return (F.when(F.col(name).isNotNull(), _hash(name)) if wanted else F.col(name)).alias(name)


def _hashes_differ(names: DataFrame) -> bool:
    """Whether no two of the distinct `names (term)` have the same hash, so that a hash stands for one name."""
    rows, hashes = names.agg(F.count("*"), F.count_distinct(_hash("term"))).first()
    return rows == hashes


def build_store(triples: DataFrame, path: str, by_subject: bool = True) -> GraphStore:
    """Write a store of `triples (s, p, o, lang)` to the folder `path`.

    `by_subject=False` leaves out the second sort order of the edges, which only `parents` and `categories` read. The dictionary is numbered by one range sort of the distinct names. Edges are encoded on
    their way to one table of pairs of numbers, without their names being stored in between; the other triples by their subject only.
    Hashes of the names move and are looked up instead of the names if no two names of the dictionary share one, which is counted.
    """
    spark = triples.sparkSession
    held = materialize(triples, "triples", "zstd")
    edge = F.col("p").isin(BROADER, SUBJECT)
    names = held.select(F.col("s").alias("term")).union(held.where(edge).select("o")).where("term is not null").distinct()
    names = materialize(names, "names")  # a range sort reads its input twice
    with ThreadPoolExecutor(1) as pool:
        differ = pool.submit(inheritable_thread_target(spark)(_hashes_differ), names)
        with_row_id(names, ["term"]).select("id", "term").write.parquet(f"{path}/terms")
    short = differ.result()
    terms = spark.read.schema("id bigint, term string").parquet(f"{path}/terms")
    count = terms.count()
    terms = terms.select("id", _hashed("term", short))

    def write_edges() -> None:
        # a mark instead of the predicate's name, so that edges are narrow while they move
        pairs = held.where(edge).select(_hashed("s", short), _hashed("o", short), (F.col("p") == BROADER).alias("up"))
        encoded = _numbered(_numbered(pairs, terms, count, "s", "sid"), terms, count, "o", "oid")
        edges = materialize(encoded.select("up", "sid", "oid"), "edges", "zstd")
        _sorted(edges, f"{path}/edges/by_object", "oid", "sid", parts=["up"])
        if by_subject:
            _sorted(edges, f"{path}/edges/by_subject", "sid", "oid", parts=["up"])

    def write_rest() -> None:
        rest = held.where(F.col("p").isin(TYPE, LABEL, TOPIC_OF, PAGE_ID)).select(_hashed("s", short), "p", "o", "lang")
        numbered = materialize(_numbered(rest, terms, count, "s", "sid").select("sid", "p", "o", "lang"), "subjects", "zstd")
        _sorted(numbered.where((F.col("p") == TYPE) & (F.col("o") == CONCEPT)).select("sid"), f"{path}/concepts", "sid")
        _sorted(numbered.where(F.col("p") == LABEL).select("sid", F.col("o").alias("label"), "lang"), f"{path}/labels", "sid")
        _sorted(numbered.where(F.col("p") == TOPIC_OF).select("sid", F.col("o").alias("url")), f"{path}/urls", "sid")
        pages = numbered.where(F.col("p") == PAGE_ID).select("sid", F.col("o").try_cast("bigint").alias("page_id"))
        _sorted(pages, f"{path}/page_ids", "sid")

    # side by side: the last tasks of one leave cores to the other
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(write)) for write in (write_edges, write_rest)]
    for run in runs:
        run.result()
    return GraphStore(spark, path)


class GraphStore(Triples):
    """The views of a stored graph. Keys are longs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @cached_property
    def grams(self) -> GramIndex:
        """Postings of the labels' q-grams, written when a search first asks for them."""
        return create_gram_index(self.labels(), scratch_path(self.spark, "grams"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _edges(self, order: str, up: bool) -> DataFrame:
        return self._read(f"edges/{order}", "sid bigint, oid bigint, up boolean").where(F.col("up") == up)

    def terms(self) -> DataFrame:
        return self._read("terms", "id bigint, term string")

    def concepts(self) -> DataFrame:
        return self._read("concepts", "sid bigint").withColumnRenamed("sid", "id")

    def labels(self) -> DataFrame:
        return self._read("labels", "sid bigint, label string, lang string").withColumnRenamed("sid", "id")

    def broader(self) -> DataFrame:
        """Sorted by parent, the side that expansion and search come from."""
        return self._edges("by_object", True).select(F.col("sid").alias("child"), F.col("oid").alias("parent"))

    def parents(self) -> DataFrame:
        """The same edges sorted by child."""
        return self._edges("by_subject", True).select(F.col("sid").alias("child"), F.col("oid").alias("parent"))

    def subjects(self) -> DataFrame:
        """Sorted by category."""
        return self._edges("by_object", False).select(F.col("sid").alias("page"), F.col("oid").alias("category"))

    def categories(self) -> DataFrame:
        """The same pairs sorted by page."""
        return self._edges("by_subject", False).select(F.col("sid").alias("page"), F.col("oid").alias("category"))

    def page_urls(self) -> DataFrame:
        return self._read("urls", "sid bigint, url string").select(F.col("sid").alias("page"), F.col("url").alias("page_url"))

    def page_ids(self) -> DataFrame:
        return self._read("page_ids", "sid bigint, page_id bigint").withColumnRenamed("sid", "page")

    def named(self, df: DataFrame, key: str, term: str) -> DataFrame:
        """Rows whose key's name contains the term: names are looked through once in the dictionary."""
        ids = self.terms().where(F.contains("term", F.lit(term))).select(F.col("id").alias(key))
        return join_small(df, ids, key)

    def encode(self, df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != name]
        terms = self.terms().withColumnRenamed("term", name)
        return join_small(terms, df, name).select(*rest, F.col("id").alias(name))

    def decode(self, df: DataFrame, *names: str) -> DataFrame:
        """Names of the keys. The result is stored first, so that the dictionary is read for keys that are in it."""
        held = materialize(df, "found")
        for name in names:
            keys = materialize(held.select(F.col(name).alias("id")).distinct(), "keys")
            rows = keys.count()
            # many keys only bound the dictionary by their range, and it is joined to the rows at once
            known = self.restrict(self.terms(), "id", keys) if rows <= BROADCAST_ROWS else self._between(self.terms(), "id", keys)
            known = known.select(F.col("id").alias(name), F.col("term").alias(f"_{name}"))
            held = join_small(held, known, name, small=rows <= BROADCAST_ROWS).drop(name).withColumnRenamed(f"_{name}", name)
        return held.select(*df.columns)

    def restrict(self, edges: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        """Few keys go into the file filter, and all others bound it by their range. `keys` is read more than once and best stored."""
        rows = keys.count()
        if rows <= BROADCAST_ROWS:
            few = keys.select(column).distinct().limit(LITERAL_KEYS + 1).collect()  # so many numbers at most
            if len(few) <= LITERAL_KEYS:
                return edges.where(F.col(column).isin([r[0] for r in few])).join(F.broadcast(keys), column)
        return join_small(self._between(edges, column, keys), keys, column, small=rows <= BROADCAST_ROWS)

    def _between(self, edges: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        low, high = keys.agg(F.min(column), F.max(column)).first()
        return edges.where(F.col(column).between(low, high))
