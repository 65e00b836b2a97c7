import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import cell_index as ci
from corpusq.operators import search
from tests.test_search import brute, data, frame, rows


def index_of(spark, tmp_path, held, metric="cosine", cells=8):
    given = spark.createDataFrame([(3 * c, [float(x) for x in v]) for c, v in enumerate(held[:cells])], "cell int, centroid array<double>")
    return ci.create_index(frame(spark, held), str(tmp_path / "index"), centroids=given, metric=metric)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_cells_give_the_exact_result(spark, tmp_path, metric):
    asked, held = data(4)
    index = index_of(spark, tmp_path, held, metric)
    found = ci.search_index(index, frame(spark, asked, "question_id"), 3, n_probe=8, offset=1, slice_rows=20)
    assert rows(found) == brute(asked, held, 3, 1, metric)


def test_few_cells_equal_probing_by_hand(spark, tmp_path):
    asked, held = data(5)
    index = index_of(spark, tmp_path, held)
    unit = lambda m: np.float32(m).astype(float) / np.maximum(np.linalg.norm(np.float32(m).astype(float), axis=1, keepdims=True), 1e-300)
    near = lambda m: np.argsort(-np.round(unit(m) @ unit(held[:8]).T, 9), axis=1, kind="stable")
    home, probed = near(held)[:, 0], near(asked)[:, :2]
    expected = []
    for i, a in enumerate(unit(asked)):
        scored = sorted((-round(float(a @ v), 9), j) for j, v in enumerate(unit(held)) if home[j] in probed[i] and v.any() and a.any())[:2]
        expected += [(i, r + 1, j, round(-s, 6)) for r, (s, j) in enumerate(scored)]
    assert rows(ci.search_index(index, frame(spark, asked, "question_id"), 2, n_probe=2)) == sorted(expected)


def test_reopened_and_loaded_in_parts(spark, tmp_path):
    asked, held = data(6)
    whole = frame(spark, held)
    given = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(held[:6])], "cell int, centroid array<double>")
    index = ci.create_index(whole.where("id < 70"), str(tmp_path / "parts"), centroids=given)
    ci.add_vectors(ci.open_index(spark, index.path), whole.where("id >= 70"))
    again = ci.open_index(spark, index.path)
    sizes = {r["cell"]: r["n"] for r in again.sizes(spark).collect()}
    counted = {r["cell"]: r["n"] for r in again.lists(spark).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert sizes == counted and sum(sizes.values()) == len(held) - 1  # one has no length
    found = ci.search_index(again, frame(spark, asked, "question_id"), 2, n_probe=6)
    assert rows(found) == brute(asked, held, 2)


def test_only_probed_partitions_are_read(spark, tmp_path):
    asked, held = data(7)
    index = index_of(spark, tmp_path, held)
    one = frame(spark, asked[:1], "question_id")
    found = ci.search_index(index, one, 2, n_probe=1)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text and "CartesianProduct" not in text
    probed = {r["cell"] for r in ci.probes(index, one, 1).collect()}
    assert len(probed) == 1


def test_fitted_cells_reach_the_recall(spark, tmp_path):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16))
    held = np.repeat(centres, 60, axis=0) + 0.25 * rnd.normal(size=(720, 16))
    index = ci.create_index(frame(spark, held), str(tmp_path / "fit"), n_cells=12)
    asked = frame(spark, held[::50], "question_id").withColumn("question_id", F.col("question_id") * 50)
    found = ci.search_index(index, asked, 10, n_probe=3)
    exact = search.top_k(asked, frame(spark, held), 10)
    assert search.recall(found, exact).first()["recall"] >= 0.9


def test_an_index_needs_centroids(spark, tmp_path):
    none = spark.createDataFrame([], "cell int, centroid array<double>")
    with pytest.raises(ValueError):
        ci.create_index(frame(spark, np.ones((2, 2))), str(tmp_path / "none"), centroids=none)
