import random

import pytest

from corpusq.operators import graph


def triples(spark, edges, labels=None, extra=()):
    names = {n for e in edges for n in e}
    labels = labels if labels is not None else [(n, n, "en") for n in names]
    rows = [(n, graph.TYPE, graph.CONCEPT, None) for n in names]
    rows += [(c, graph.BROADER, p, None) for p, c in edges]
    rows += [(i, graph.LABEL, t, lang) for i, t, lang in labels]
    return spark.createDataFrame(rows + list(extra), "s string, p string, o string, lang string")


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def tables(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "category string")


def test_search_counts_joined_rows(spark):
    edges = [("Top", f"c{i}") for i in range(3)] + [("Other", f"d{i}") for i in range(6)]
    labels = [("Top", "Top", "en"), ("Top", "The top", "en"), ("Top", "Oben", "de"), ("Other", "Other", "en")]
    g = triples(spark, edges, labels)
    # two labels count each child twice; the term is compared with its case
    assert [tuple(r) for r in graph.concept_search(g, "o").collect()] == [("Top", 6)]
    assert [tuple(r) for r in graph.concept_search(g, "t").collect()] == [("Other", 6)]
    assert graph.concept_search(g, "t", min_children=6).count() == 0


def test_search_by_label(spark):
    edges = [(p, f"{p}{i}") for p in ("A", "B", "C") for i in range(3)] + [("D", "D0"), ("D", "D1")]
    labels = [("A", "air", "en"), ("A", "fair", "en"), ("B", "airline songs", "en"), ("C", "air", "de"), ("D", "air", "en")]
    g = triples(spark, edges, labels)
    assert [tuple(r) for r in graph.concept_search(g, "air", "label", words(spark, "song")).collect()] == [("A", 3)]
    assert {r["id"] for r in graph.concept_search(g, "air", "label").collect()} == {"A", "B"}


@pytest.mark.parametrize("term", ["", None])
def test_search_without_term_is_empty(spark, term):
    assert graph.concept_search(triples(spark, [("A", "b")]), term, min_children=0).count() == 0


def test_stop_words_match_inside_words(spark):
    rows = spark.createDataFrame([(1, "baby"), (2, "list of x"), (3, "city"), (4, ""), (5, "by")], "i int, label string")
    for limit in (200, 0):  # as literals and as a join
        kept = graph.without_stop_words(rows, "label", words(spark, "by", "list", "a longer stop word"), limit)
        assert sorted(r["i"] for r in kept.collect()) == [3, 4]


def test_stop_word_join_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "baby")], "i int, label string")
    plan = graph.without_stop_words(rows, "label", words(spark, "by"), 0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_narrower(spark):
    g = triples(spark, [("A", "x"), ("A", "song y"), ("B", "x"), ("C", "z")])
    found = graph.narrower(g, tables(spark, "A", "B"), 3, words(spark, "song")).collect()
    assert sorted(tuple(r) for r in found) == [(3, "A", "x"), (3, "B", "x")]


def bfs(edges, roots, depth):
    seen, frontier, out = set(roots), set(roots), {}
    for level in range(depth):
        frontier = {c for p, c in edges if p in frontier} - seen
        if not frontier:
            break
        seen |= frontier
        out.update({c: level for c in frontier})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_expand_on_random_graphs_with_cycles(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(50)}
    found = graph.expand(triples(spark, sorted(edges)), tables(spark, "n0", "n1"), 4)
    assert {r["category"]: r["level"] for r in found.collect()} == bfs(edges, {"n0", "n1"}, 4)
    assert found.count() == found.select("category").distinct().count()


def test_expand_all_paths(spark):
    g = triples(spark, [("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("x", "r")])
    found = graph.expand(g, tables(spark, "r"), 4, dedupe=False).collect()
    assert sorted(tuple(r) for r in found) == [
        (0, "a"), (0, "b"), (1, "x"), (1, "x"), (2, "r"), (2, "r"), (3, "a"), (3, "a"), (3, "b"), (3, "b")
    ]


def test_expand_of_a_leaf_is_empty(spark):
    assert graph.expand(triples(spark, [("a", "b")]), tables(spark, "b"), 2).count() == 0


def test_pages_per_batch(spark):
    extra = [(f"P{i}", graph.SUBJECT, c, None) for i, c in [(1, "a"), (1, "b"), (2, "b"), (3, "z")]]
    extra += [(f"P{i}", graph.TOPIC_OF, f"url{i}", None) for i in (1, 2, 3)]
    extra += [(f"P{i}", graph.PAGE_ID, str(i), None) for i in (1, 2, 3)]
    g = triples(spark, [("r", "a"), ("r", "b")], extra=extra)
    once = graph.category_pages(g, tables(spark, "a", "b")).collect()
    assert sorted(tuple(r) for r in once) == [("url1", 1), ("url2", 2)]
    batched = graph.category_pages(g, tables(spark, "a", "b"), per_batch=True, batch_size=1).collect()
    assert sorted(tuple(r) for r in batched) == [("url1", 1), ("url1", 1), ("url2", 2)]


def test_option_order(spark):
    found = spark.createDataFrame([("b",), ("É",), ("a",), ("f",), ("B",)], "id string")
    shown = [r["text"] for r in graph.options(found, by_text=True).collect()]
    assert shown == ["a", "b", "B", "É", "f"]


def test_predicate_is_pushed_to_the_files(spark, tmp_path):
    path = str(tmp_path / "triples")
    triples(spark, [("A", "b")]).write.partitionBy("p").parquet(path)
    stored = spark.read.parquet(path)
    plan = graph.concept_search(stored, "ex")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(o,ex)" in plan or "StringContains(s,ex)" in plan
    assert "PartitionFilters: [isnotnull(p" in plan


def test_null_texts_are_dropped_under_short_and_long_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, "fine"), (3, "has stop")], "id int, label string")
    words = spark.createDataFrame([("stop",)], "word string")
    for literal in (0, 200):
        found = graph.without_stop_words(rows, "label", words, literal_words=literal)
        assert [r["id"] for r in found.collect()] == [2]
