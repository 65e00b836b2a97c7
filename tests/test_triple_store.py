import random

import pytest
from pyspark.sql import functions as F

from corpusq.operators import grams, graph
from corpusq.operators.triple_store import build_store
from tests.test_graph import bfs, tables, triples, words


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_graph(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(90)})
    labels = [(f"n{i}", f"name {i} " + rnd.choice(["alpha", "song", "beta alphabet"]), rnd.choice(["en", "en", "de"])) for i in range(40) for _ in range(rnd.choice([1, 2]))]
    extra = [(f"P{i}", graph.SUBJECT, f"n{rnd.randrange(40)}", None) for i in range(60)]
    extra += [(f"P{i}", graph.TOPIC_OF, f"url{i}", None) for i in range(60)] + [(f"P{i}", graph.PAGE_ID, str(i), None) for i in range(60)]
    return triples(spark, edges, labels, extra).distinct()


@pytest.mark.parametrize("seed", [2])
def test_store_gives_what_the_triples_give(spark, tmp_path, seed):
    g = random_graph(spark, seed)
    store = build_store(g, str(tmp_path / "store"))
    stop, roots = words(spark, "song"), tables(spark, "n0", "n1", "not there")
    for one, two in (
        (graph.concept_search(g, "n1", min_children=1), graph.concept_search(store, "n1", min_children=1)),
        (graph.concept_search(g, "alpha", "label", stop, 0), graph.concept_search(store, "alpha", "label", stop, 0)),
        (graph.concept_search(g, "a", "label", min_children=0), graph.concept_search(store, "a", "label", min_children=0)),
        (graph.concept_search(g, "nowhere", "label"), graph.concept_search(store, "nowhere", "label")),
        (graph.narrower(g, roots, 2, stop), graph.narrower(store, roots, 2, stop)),
        (graph.expand(g, roots, 4, stop), graph.expand(store, roots, 4, stop)),
        (graph.expand_paths(g, roots, 4), graph.expand_paths(store, roots, 4)),
        (graph.category_pages(g, tables(spark, "n1", "n2", "n3")), graph.category_pages(store, tables(spark, "n1", "n2", "n3"))),
        (graph.category_pages(g, tables(spark, "n1", "n2", "n3"), True, 2), graph.category_pages(store, tables(spark, "n1", "n2", "n3"), True, 2)),
    ):
        assert one.columns == two.columns and found(one) == found(two)
    assert sorted(store.parents().collect()) == sorted(store.broader().collect())
    assert store.terms().where("term = 'n7'").first()["id"] < store.terms().where("term = 'n8'").first()["id"]


def test_no_name_is_shuffled_before_the_result(spark, tmp_path):
    store = build_store(random_graph(spark, 3), str(tmp_path / "store"))
    edges = store.restrict(store.broader(), "parent", store.encode(tables(spark, "n0", "n1"), "category").withColumnRenamed("category", "parent"))
    step = edges.groupBy("child").agg(F.count("*").alias("paths"))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "term" not in plan and "PushedFilters: [In(oid" in plan.replace("IsNotNull(oid), ", "") or "In(oid" in plan


def test_ways_are_added_up(spark):
    """Thirty diamonds in a row: 2^30 ways to the last node, a handful of rows for each level."""
    edges = [e for i in range(30) for e in ((f"x{i}", f"a{i}"), (f"x{i}", f"b{i}"), (f"a{i}", f"x{i + 1}"), (f"b{i}", f"x{i + 1}"))]
    rows = graph.expand_paths(triples(spark, edges), tables(spark, "x0"), 60)
    last = rows.where("level = 59").collect()
    assert [(r["category"], r["paths"]) for r in last] == [("x30", 2**30)]
    assert rows.count() == 90


def test_only_the_frontier_is_joined(spark, monkeypatch):
    written = {}
    real = graph.materialize

    def watched(df, name):
        stored = real(df, name)
        written[name] = max(written.get(name, 0), stored.count())
        return stored

    monkeypatch.setattr(graph, "materialize", watched)
    edges = [(f"far{i}", f"other{i}") for i in range(500)] + [("r", "a"), ("a", "b")]
    assert graph.expand(triples(spark, edges), tables(spark, "r"), 3).count() == 2
    assert max(written.values()) <= 2


@pytest.mark.parametrize("q", [2, 3])
def test_gram_index_equals_a_scan(spark, tmp_path, q):
    rnd = random.Random(q)
    texts = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.choice([0, 1, 2, 5, 40])))) for i in range(400)]
    df = spark.createDataFrame(texts, "id long, label string")
    index = grams.create_gram_index(df, str(tmp_path / f"g{q}"), q=q, buckets=4)
    for term in ("abc", "a é", "abcab", "zzz", "bb", "a"):
        near = grams.candidates(index, spark, term)
        if len(term) < q:
            assert near is None
            continue
        hits = {i for i, t in texts if term in t}
        held = {r["id"] for r in near.collect()}
        assert hits <= held and held <= {i for i, t in texts if any(term[k : k + q] in t for k in range(len(term)))}


def test_words_by_their_rarest_gram(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.choice([0, 1, 3, 60]))) for _ in range(300)]
    list_ = ["a", "bd", "abc", "dcba", "ab cd", "x", "xyz", "cccc", "dadada"]
    df = spark.createDataFrame([(t,) for t in texts], "label string")
    hit = grams.texts_with_words(df, words(spark, *list_))
    assert {r["label"] for r in hit.collect()} == {t for t in texts if any(w in t for w in list_)}
    long = grams.texts_with_words(df, words(spark, "abc", "dcba", "dadada"))
    assert {r["label"] for r in long.collect()} == {t for t in texts if any(w in t for w in ("abc", "dcba", "dadada"))}
    assert grams.texts_with_words(df, words(spark).where("false")).count() == 0


def test_rows_are_linear_in_the_text(spark, monkeypatch):
    kept = {}
    real = grams.materialize
    monkeypatch.setattr(grams, "materialize", lambda df, name: kept.setdefault(name, real(df, name)))
    text = "".join(chr(97 + (i * i) % 26) for i in range(2_000))
    df = spark.createDataFrame([(text,)], "label string")
    list_ = [text[10 : 10 + n] for n in range(3, 60)] + ["zq", "a long word that is not there"]
    assert grams.texts_with_words(df, words(spark, *list_)).count() == 1
    assert kept["held"].count() <= 2 * len(text)


def test_edges_are_stored_as_numbers_only(spark, tmp_path, monkeypatch):
    from corpusq.operators import triple_store

    kept = {}
    keep = triple_store.materialize
    monkeypatch.setattr(triple_store, "materialize", lambda df, name, *rest: kept.setdefault(name, keep(df, name, *rest)))
    g = random_graph(spark, 3)
    store = build_store(g, str(tmp_path / "store"))
    monkeypatch.undo()
    assert dict(kept["edges"].dtypes) == {"up": "boolean", "sid": "bigint", "oid": "bigint"}
    assert kept["subjects"].where(F.col("p").isin(graph.BROADER, graph.SUBJECT)).count() == 0
    for one, two in ((store.broader(), graph.view(g).broader()), (store.subjects(), graph.view(g).subjects())):
        assert found(store.decode(one, *one.columns)) == found(two.select(*one.columns))


@pytest.mark.parametrize("small, hashed, join", [(200_000, 2_000_000, "BroadcastHashJoin"), (0, 2_000_000, "ShuffledHashJoin"), (0, 0, "SortMergeJoin")])
def test_large_stores_give_the_same(spark, tmp_path, monkeypatch, small, hashed, join):
    """Names become numbers, and keys names, without a sort of the long side as long as a task's share of the names is bounded."""
    from corpusq import session
    from corpusq.operators import triple_store

    monkeypatch.setattr(session, "BROADCAST_ROWS", small)
    monkeypatch.setattr(triple_store, "BROADCAST_ROWS", small)
    monkeypatch.setattr(session, "HASHED_ROWS_PER_TASK", hashed)
    # nulls and rows that come twice: a name beside a null is numbered, the edge is not
    odd = [("P1", graph.SUBJECT, None, None), (None, graph.SUBJECT, "n1", None), ("P1", graph.SUBJECT, "n1", None), ("only", graph.BROADER, None, None)]
    g = random_graph(spark, 5).union(spark.createDataFrame(odd * 2, "s string, p string, o string, lang string"))
    store = build_store(g, str(tmp_path / "store"))
    edges = graph.view(g).subjects().where("page is not null and category is not null")
    assert found(store.decode(store.subjects(), "page", "category")) == found(edges)
    names = {r[0] for r in g.select("s").union(g.where(F.col("p").isin(graph.BROADER, graph.SUBJECT)).select("o")).collect()} - {None}
    assert [r["term"] for r in store.terms().orderBy("id").collect()] == sorted(names)
    roots = tables(spark, "n0", "n1", "not there")
    assert found(graph.narrower(store, roots, 2, words(spark, "song"))) == found(graph.narrower(g, roots, 2, words(spark, "song")))
    assert found(graph.category_pages(store, roots)) == found(graph.category_pages(g, roots))
    held = store.terms()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = triple_store._numbered(g.select("s"), held, held.count(), "s", "sid")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert join in plan


@pytest.mark.parametrize("query", [graph.narrower, graph.category_pages])
def test_given_categories_are_read_once(spark, tmp_path, query):
    store = build_store(random_graph(spark, 3), str(tmp_path / "store"))
    read = spark.sparkContext.accumulator(0)

    def seen(name):
        read.add(1)
        return name

    given = tables(spark, "n0", "n1", "n2").coalesce(1).select(F.udf(seen, "string")("category").alias("category"))
    query(store, given).collect()
    assert read.value == 3


def test_names_are_put_together_once(spark, tmp_path, monkeypatch):
    """The range sort of the dictionary reads its input twice: that is the stored names."""
    from corpusq.operators import triple_store

    given, real = [], triple_store.with_row_id
    monkeypatch.setattr(triple_store, "with_row_id", lambda df, *rest: given.append(df) or real(df, *rest))
    build_store(random_graph(spark, 3), str(tmp_path / "store"))
    assert "Aggregate" not in given[0]._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_names_move_unless_two_names_share_one(spark, tmp_path, monkeypatch):
    from corpusq.operators import triple_store

    g = random_graph(spark, 4)
    moved, numbered = [], triple_store._numbered
    monkeypatch.setattr(triple_store, "_numbered", lambda rows, *rest: moved.append(dict(rows.dtypes)) or numbered(rows, *rest))
    for name, kind in (("apart", "bigint"), ("shared", "string")):
        if name == "shared":
            monkeypatch.setattr(triple_store, "_hash", lambda name: F.length(name).cast("bigint"))
        moved.clear()
        store = build_store(g, str(tmp_path / name))
        assert {row[c] for row in moved for c in ("s", "o") if c in row and not (c == "o" and "p" in row)} == {kind}
        for one, two in ((store.broader(), graph.view(g).broader()), (store.subjects(), graph.view(g).subjects())):
            assert found(store.decode(one, *one.columns)) == found(two.select(*one.columns))


@pytest.mark.parametrize("kinds", [(graph.BROADER,), (graph.SUBJECT,), ()])
def test_a_store_without_one_kind_of_edges(spark, tmp_path, kinds):
    g = random_graph(spark, 4).where(F.col("p").isin(graph.LABEL, *kinds))
    store = build_store(g, str(tmp_path / "store"))
    for kind, views in ((graph.BROADER, (store.broader(), store.parents())), (graph.SUBJECT, (store.subjects(), store.categories()))):
        rows = g.where(F.col("p") == kind).count()
        assert [v.count() for v in views] == [rows, rows] and (rows > 0) == (kind in kinds)


def test_selected_pages_go_by_keys(spark, tmp_path, monkeypatch):
    """Categories are not turned into names and back, and only pages with a text meet their urls and times."""
    from corpusq.operators import triple_store
    from corpusq.plans import corpus

    g = random_graph(spark, 6).union(spark.createDataFrame([("P1", graph.TOPIC_OF, "again", None), ("P2", graph.PAGE_ID, None, None)], "s string, p string, o string, lang string"))
    store, roots = build_store(g, str(tmp_path / "store")), tables(spark, "n0", "n1", "n0", "not there")
    texts = spark.createDataFrame([(i, f"text {i}") for i in (*range(0, 40), 1, 700, None)], "page_id long, content string")
    bounds = spark.createDataFrame([(i, i, i + 1) for i in range(0, 60, 2)] + [(1, 5, 6)], "page_id long, creation_date int, last_modified int")
    categories = graph.expand(g, roots, 3).select("category")
    expected = texts.join(graph.category_pages(g, categories), "page_id").join(bounds, "page_id")
    plain = corpus.selected_pages(g, roots, 3, texts, bounds)
    kept, keep = {}, corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, name, *rest: kept.setdefault(name, keep(df, name, *rest)))
    monkeypatch.setattr(triple_store.GraphStore, "decode", None)
    stored = corpus.selected_pages(store, roots, 3, texts, bounds)
    assert expected.count() > 5 and found(stored.select(*expected.columns)) == found(plain.select(*expected.columns)) == found(expected)
    assert {r["page_id"] for r in kept["page-ids"].collect()} <= set(range(40))
    kept.clear()
    assert corpus.selected_pages(store, roots, 0, texts, bounds).count() == 0


def test_pages_wanted_only(spark, tmp_path):
    g = random_graph(spark, 7)
    store, only = build_store(g, str(tmp_path / "store")), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "page_id long")
    given = tables(spark, "n1", "n2", "n3", "n4")
    every = graph.category_pages(g, given).collect()
    for one in (g, store):
        assert found(graph.category_pages(one, given, only=only)) == sorted((tuple(r) for r in every if r["page_id"] % 3 == 0), key=str)
