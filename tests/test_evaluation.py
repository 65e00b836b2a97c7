import math

import numpy as np
import pytest

from corpusq.operators import evaluation as ev


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_histogram_is_numpys(spark):
    rnd = np.random.default_rng(1)
    values = [float(x) for x in rnd.normal(size=500)]
    counts, edges = np.histogram(values, bins=20)
    found = {r["bin"]: r for r in ev.histogram(column(spark, values), "v", 20).collect()}
    assert [found[i + 1]["n"] if i + 1 in found else 0 for i in range(20)] == counts.tolist()
    assert found[20]["high"] == pytest.approx(edges[-1])


@pytest.mark.parametrize("kind", ["int", "double"])
def test_automatic_bins_are_numpys(spark, kind):
    rnd = np.random.default_rng(2)
    values = [int(x) if kind == "int" else float(x) for x in rnd.gamma(2.0, 50.0, size=400)]
    counts, edges = np.histogram(np.array(values, dtype=float), bins="auto")
    found = ev.histogram(column(spark, values, kind), "v", "auto").collect()
    assert sum(r["n"] for r in found) == 400
    assert max(r["bin"] for r in found) == len(counts)
    assert sorted((r["bin"], r["n"]) for r in found) == [(i + 1, int(c)) for i, c in enumerate(counts) if c]


def test_histogram_of_one_value_and_of_nothing(spark):
    assert sum(r["n"] for r in ev.histogram(column(spark, [3, 3, None], "int"), "v", "auto").collect()) == 2
    assert ev.histogram(column(spark, [None], "int"), "v", 5).count() == 0


def test_histogram_by_group(spark):
    rows = spark.createDataFrame([(1, 0), (1, 10), (2, 10)], "g int, v int")
    found = sorted((r["g"], r["bin"], r["n"]) for r in ev.histogram(rows, "v", 5, by="g").collect())
    assert found == [(1, 1, 1), (1, 5, 1), (2, 5, 1)]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_density(spark, kind):
    values = [1, 1, 4, 9] if kind == "int" else [1.0, 1.0, 4.0, 9.0]
    found = {r["point"]: r["density"] for r in ev.density(column(spark, values, kind), "v", [0.0, 5.0], 2.0).collect()}
    for p in (0.0, 5.0):
        expected = sum(math.exp(-((p - v) / 2.0) ** 2 / 2) for v in values) / (4 * 2.0 * math.sqrt(2 * math.pi))
        assert found[p] == pytest.approx(expected)


def test_density_by_rule(spark):
    values = np.random.default_rng(3).normal(size=60)
    found = {r["point"]: r["density"] for r in ev.density(column(spark, [float(v) for v in values]), "v", 7).collect()}
    h = values.std(ddof=1) * 60 ** -0.2
    for p in np.linspace(values.min(), values.max(), 7):
        near = min(found, key=lambda x: abs(x - p))
        expected = np.exp(-((p - values) / h) ** 2 / 2).sum() / (60 * h * math.sqrt(2 * math.pi))
        assert near == pytest.approx(p) and found[near] == pytest.approx(expected)
    assert ev.density(column(spark, [2.0, 2.0]), "v", [2.0]).first()["density"] == pytest.approx(1 / math.sqrt(2 * math.pi))


def test_stats_and_pairs(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>, q array<float>")
    scored = ev.pair_scores(rows, "a", "b", "q", manhattan=True)
    first = scored.first()
    assert first["manhattan_distance"] == 2.0
    assert first["cosine_similarity"] == 0.0 and first["cosine_similarity_question_a"] == pytest.approx(0.5 ** 0.5)
    stats = {r["column"]: r for r in ev.score_stats(scored, "cosine_similarity", "cosine_similarity_question_a").collect()}
    assert stats["cosine_similarity"]["mean"] == 0.0 and stats["cosine_similarity_question_a"]["n"] == 1


def test_unanswered_questions_stay(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    a = spark.createDataFrame([(1, "x")], "question_id int, answer string")
    assert sorted((r["question_id"], r["answer"]) for r in ev.with_answers(q, a).collect()) == [(1, "x"), (2, None)]


def test_quantiles_count_every_value_as_often_as_it_occurs(spark):
    values = [1, 1, 1, 1, 2, 5, 5, 9, 9, 9, 9, 9, 40]
    rows = [(float(v), values.count(v)) for v in set(values)]
    counts = spark.createDataFrame(rows, "value double, n bigint").repartition(3)
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    assert np.allclose(ev.weighted_quantiles(counts, shares), np.quantile(values, shares))


def test_density_on_a_grid_keeps_its_bound(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    values = rnd.normal(size=500).round(6).tolist()
    points, h = [-2.0, -0.5, 0.0, 1.3], 0.4
    exact = {p: float(np.exp(-(((p - np.array(values)) / h) ** 2) / 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))) for p in points}
    sizes = []
    real = ev.materialize
    monkeypatch.setattr(ev, "materialize", lambda df, name: sizes.append(real(df, name)) or sizes[-1])
    for grid in (64, 1_024):
        found = {r["point"]: r["density"] for r in ev.density(column(spark, values), "v", points, h, grid).collect()}
        step = (max(values) - min(values)) / grid
        assert max(abs(found[p] - exact[p]) for p in points) <= step**2 / (20 * h**3)
    assert all(s.count() <= len(values) for s in sizes)  # no row for each value and point


def test_variance_does_not_cancel(spark):
    far = [1e9 + x for x in (0.0, 1.0, 2.0, 3.0)]
    near = ev.density(column(spark, [0.0, 1.0, 2.0, 3.0]), "v", 3).collect()
    moved = ev.density(column(spark, far), "v", 3).collect()
    assert [r["density"] for r in moved] == pytest.approx([r["density"] for r in near], rel=1e-4)
