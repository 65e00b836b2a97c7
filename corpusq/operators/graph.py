"""Search, expansion and page lookup on a category graph held as triples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.grams import Q, GramIndex, candidates, texts_with_words
from corpusq.operators.rowid import with_batches
from corpusq.session import at_most, join_small, materialize

# Predicates of the graph, language and thresholds of the two searches.
TYPE = "rdf:type"
CONCEPT = "skos:Concept"
LABEL = "rdfs:label"
BROADER = "skos:broader"
SUBJECT = "dcterms:subject"
TOPIC_OF = "foaf:isPrimaryTopicOf"
PAGE_ID = "dbo:wikiPageID"
LANGUAGE = "en"
MIN_CHILDREN_BY_ID = 5
MIN_CHILDREN_BY_LABEL = 2
CATEGORIES_PER_BATCH = 50

# Stop words that are put in the plan as literals; a longer list is joined.
LITERAL_WORDS = 200


# --- views of the triples ---------------------------------------------------


def pattern(triples: DataFrame, predicate: str) -> DataFrame:
    """`?s <predicate> ?o`; with triples partitioned by `p` other partitions are not read."""
    return triples.where(F.col("p") == predicate)


class Triples:
    """Views of a plain table of triples `(s, p, o, lang)`. Keys are the names themselves.

    The operators below take such a table, or a `triple_store.GraphStore` with the same views whose keys are numbers.
    """

    grams: GramIndex | None = None

    def __init__(self, triples: DataFrame):
        self.triples, self.spark = triples, triples.sparkSession

    def concepts(self) -> DataFrame:
        return pattern(self.triples, TYPE).where(F.col("o") == CONCEPT).select(F.col("s").alias("id"))

    def labels(self) -> DataFrame:
        return pattern(self.triples, LABEL).select(F.col("s").alias("id"), F.col("o").alias("label"), "lang")

    def broader(self) -> DataFrame:
        return pattern(self.triples, BROADER).select(F.col("s").alias("child"), F.col("o").alias("parent"))

    def subjects(self) -> DataFrame:
        return pattern(self.triples, SUBJECT).select(F.col("s").alias("page"), F.col("o").alias("category"))

    def page_urls(self) -> DataFrame:
        return pattern(self.triples, TOPIC_OF).select(F.col("s").alias("page"), F.col("o").alias("page_url"))

    def page_ids(self) -> DataFrame:
        return pattern(self.triples, PAGE_ID).select(F.col("s").alias("page"), F.col("o").try_cast("bigint").alias("page_id"))

    def named(self, df: DataFrame, key: str, term: str) -> DataFrame:
        """Rows whose key's name contains the term; pushed to the files."""
        return df.where(F.contains(F.col(key), F.lit(term)))

    def encode(self, df: DataFrame, name: str) -> DataFrame:
        """Names to keys; names that the graph does not have drop out or find nothing."""
        return df

    def decode(self, df: DataFrame, *names: str) -> DataFrame:
        """Keys to names."""
        return df

    def restrict(self, edges: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        """Rows of `edges` whose `column` is among the distinct `keys (column)`."""
        return join_small(edges, keys, column)


def view(graph: DataFrame | Triples) -> Triples:
    return Triples(graph) if isinstance(graph, DataFrame) else graph


def labels(triples: DataFrame) -> DataFrame:
    return view(triples).labels()


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A relation given in the call."""
    return spark.createDataFrame(list(rows), schema)


# --- stop words -------------------------------------------------------------


def without_stop_words(df: DataFrame, text: str, stop_words: DataFrame | None, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """Drop rows whose text contains a stop word anywhere, also inside a word. A null text does not
    bind and is dropped whatever the list holds; without a list nothing is dropped.

    A short list, its length checked first, becomes part of the filter. A long
    one is joined: each word is looked up by its rarest q-gram (see `grams`).
    """
    return stop_word_filter(stop_words, literal_words)(df, text)


def stop_word_filter(stop_words: DataFrame | None, literal_words: int = LITERAL_WORDS) -> Callable[[DataFrame, str], DataFrame]:
    """`without_stop_words` for one list, to be used several times: the list is counted and read once."""
    if stop_words is None:
        return lambda df, text: df
    wanted = stop_words.select(F.col(stop_words.columns[0]).alias("word")).where(F.col("word") != "").distinct()
    if at_most(wanted, literal_words):
        short = [row["word"] for row in sorted(wanted.collect())]

        def filtered(df: DataFrame, text: str) -> DataFrame:
            keep = df.where(F.col(text).isNotNull())
            for word in short:
                keep = keep.where(~F.contains(F.col(text), F.lit(word)))
            return keep

        return filtered
    stored = materialize(wanted, "stop-words")

    def joined(df: DataFrame, text: str) -> DataFrame:
        bound = df.where(F.col(text).isNotNull())
        return bound.join(texts_with_words(bound.select(text), stored), text, "left_anti")

    return joined


# --- search -----------------------------------------------------------------


def concept_search(
    triples: DataFrame | Triples, term: str | None, mode: str = "id", stop_words: DataFrame | None = None,
    min_children: int | None = None, lang: str = LANGUAGE,
) -> DataFrame:
    """Concepts with many narrower concepts: `(id, n)`, most first.

    `mode='id'` looks for the term in the id and counts joined rows per concept,
    so a concept with two labels in the language counts each child twice.
    `mode='label'` looks for it in the label, drops labels that contain a stop
    word, counts per (concept, label) and gives each concept once with its
    highest count.

    Children and labels are counted on their own side first. Both counts are
    combined before their shuffle and the join is one row to one row, so a
    concept with most of the children is not a heavy join key.
    """
    if mode not in ("id", "label"):
        raise ValueError(f"mode must be 'id' or 'label', not {mode!r}")
    g = view(triples)
    named = g.labels().where(F.col("lang") == lang)
    edges, types = g.broader(), g.concepts()
    if not term:
        named = named.where(F.lit(False))
    if mode == "id":
        floor = MIN_CHILDREN_BY_ID if min_children is None else min_children
        if term:
            named, types, edges = g.named(named, "id", term), g.named(types, "id", term), g.named(edges, "parent", term)
        per_concept = named.groupBy("id").agg(F.count("*").alias("names"))
    else:
        floor = MIN_CHILDREN_BY_LABEL if min_children is None else min_children
        if term:
            # ids whose labels hold the term's rarest grams
            near = candidates(g.grams, g.spark, term) if len(term) >= Q and g.grams else None
            if near is not None:
                named = join_small(named, near, "id")
            named = without_stop_words(named.where(F.contains(F.col("label"), F.lit(term))), "label", stop_words)
        per_label = named.groupBy("id", "label").agg(F.count("*").alias("names"))
        # the matched ids are stored, then only their edges are counted
        per_concept = materialize(per_label.groupBy("id").agg(F.max("names").alias("names")), "matched")
        edges = g.restrict(edges, "parent", per_concept.select(F.col("id").alias("parent")))
    children = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    found = (
        per_concept.join(children, "id")
        .join(types, "id")
        .select("id", (F.col("children") * F.col("names")).alias("n"))
        .where(F.col("n") > floor)
    )
    return g.decode(found, "id").select("id", "n").orderBy(F.desc("n"), "id")


def options(found: DataFrame, by_text: bool = False) -> DataFrame:
    """Search results as `{id, text}` options, optionally in the text order of a reader."""
    shown = found.select("id", F.col("id").alias("text"))
    return shown.orderBy(F.expr("text COLLATE UNICODE"), "id") if by_text else shown


# --- expansion --------------------------------------------------------------


def _allowed(g: Triples, children: DataFrame, clean: Callable[[DataFrame, str], DataFrame], lang: str) -> DataFrame:
    """Of the distinct `children (child)` those with a label in the language without any stop word. Labels
    are looked up for these children only."""
    named = g.restrict(g.labels().where(F.col("lang") == lang).withColumnRenamed("id", "child"), "child", children)
    return clean(named, "label").select("child").distinct()


def narrower(
    triples: DataFrame | Triples, parents: DataFrame, level: int = 0, stop_words: DataFrame | None = None, lang: str = LANGUAGE
) -> DataFrame:
    """Children of a table of categories: `(level, parent, child)`, distinct. Parents come first: only their edges and only their
    children's labels are read further."""
    g = view(triples)
    wanted = materialize(parents.select(F.col(parents.columns[0]).alias("parent")).distinct(), "parents")
    wanted = materialize(g.encode(wanted, "parent"), "wanted")
    edges = materialize(g.restrict(g.broader(), "parent", wanted).select("parent", "child"), "narrower")
    allowed = _allowed(g, materialize(edges.select("child").distinct(), "children"), stop_word_filter(stop_words), lang)
    found = edges.join(allowed, "child").select(F.lit(level).alias("level"), "parent", "child")
    return g.decode(found, "parent", "child").select("level", "parent", "child")


def _levels(
    triples: DataFrame | Triples, roots: DataFrame, depth: int, stop_words: DataFrame | None, dedupe: bool, lang: str,
    named: bool = True,
) -> DataFrame:
    """`(level, category, paths)`. Each level joins the frontier's edges only, and adds up the ways to each child."""
    g = view(triples)
    spark, clean = g.spark, stop_word_filter(stop_words)
    frontier = roots.select(F.col(roots.columns[0]).alias("category")).groupBy("category").agg(F.count("*").alias("paths"))
    frontier = materialize(g.encode(frontier, "category"), "roots")
    seen, levels = frontier.select("category"), []
    for level in range(depth):
        near = frontier.select(F.col("category").alias("parent"), "paths")
        step = g.restrict(g.broader(), "parent", near).groupBy("child").agg(F.sum("paths").alias("paths"))
        if dedupe:
            step = step.join(seen.withColumnRenamed("category", "child"), "child", "left_anti")
        step = materialize(step, "children")
        allowed = _allowed(g, step.select("child"), clean, lang)
        frontier = materialize(step.join(allowed, "child").select(F.col("child").alias("category"), "paths"), f"level{level}")
        if frontier.isEmpty():
            break
        levels.append(frontier.select(F.lit(level).alias("level"), "category", "paths"))
        seen = seen.unionByName(frontier.select("category")) if dedupe else seen
    if not levels:
        kind = dict(frontier.dtypes)["category"] if not named else "string"
        return spark.createDataFrame([], f"level int, category {kind}, paths bigint")
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    return (g.decode(result, "category") if named else result).select("level", "category", "paths")


def expand_paths(
    triples: DataFrame | Triples, roots: DataFrame, depth: int, stop_words: DataFrame | None = None, lang: str = LANGUAGE
) -> DataFrame:
    """All categories below the roots by level with the number of ways that lead there: `(level, category, paths)`. Ways are added up
    level by level, so a category costs one row however many ways there are."""
    return _levels(triples, roots, depth, stop_words, False, lang)


def expand(
    triples: DataFrame | Triples, roots: DataFrame, depth: int, stop_words: DataFrame | None = None, dedupe: bool = True,
    lang: str = LANGUAGE, named: bool = True,
) -> DataFrame:
    """All categories below the roots, level by level: `(level, category)`. With `named=False` the graph's own keys
    stand for the categories, for an operator that goes on in the same graph.

    Level 0 holds the children of the roots. With `dedupe` a category is listed
    once, at its first level, and roots are never listed, so cycles end. Without
    it every path counts, as when parents are asked one by one (`expand_paths` gives their number instead).

    Each level reads the edges of its frontier and the labels of their children, and is written to the shared folder, so the plan
    does not grow and a lost executor costs no earlier level.
    """
    found = _levels(triples, roots, depth, stop_words, dedupe, lang, named)
    if dedupe:
        return found.select("level", "category")
    return found.select("level", "category", F.explode(F.sequence(F.lit(1).cast("bigint"), "paths")).alias("_way")).drop("_way")


# --- pages ------------------------------------------------------------------


def category_pages(
    triples: DataFrame | Triples, categories: DataFrame, per_batch: bool = False, batch_size: int = CATEGORIES_PER_BATCH,
    order_by: Sequence[str | Column] | None = None, named: bool = True, only: DataFrame | None = None,
) -> DataFrame:
    """Pages of a table of categories: `(page_url, page_id)`. With `named=False` the categories are the graph's own keys.
    `only` is a stored table of distinct `page_id`s that are wanted; other pages go before urls are joined.

    Distinct over all categories. With `per_batch` the categories are taken in
    batches in a stated order and pages are distinct inside a batch only, so a
    page of two batches comes twice.

    Categories and pages meet first on the narrow subject pairs and are made
    distinct there, before urls are joined.
    """
    g = view(triples)
    name = categories.columns[0]
    wanted = categories.select(F.col(name).alias("category"))
    batch: list[str] = []
    if per_batch:
        wanted = with_batches(wanted, order_by or ["category"], batch_size)
        batch = ["batch_id"]
    # stored before and after: sizes are asked for first, and the keys are read more than once
    wanted = materialize(wanted.distinct(), "categories")
    wanted = materialize(g.encode(wanted, "category"), "wanted") if named else wanted
    found = g.restrict(g.subjects(), "category", wanted).select(*batch, "page").distinct()
    numbers = g.page_ids() if only is None else join_small(g.page_ids(), only, "page_id", "left_semi")
    return found.join(numbers, "page").join(g.page_urls(), "page").select(*batch, "page_url", "page_id").distinct().drop(*batch)
