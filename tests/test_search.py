import numpy as np
import pytest

from corpusq.functions import blocks
from corpusq.functions import vectors as vx
from corpusq.operators import embedding as emb
from corpusq.operators import search
from corpusq.session import materialize
from pyspark.sql import functions as F


def frame(spark, matrix, name="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>").repartition(3)


def brute(questions, vectors, k, offset=0, metric="cosine"):
    q, v = np.float32(questions).astype(float), np.float32(vectors).astype(float)
    out = []
    for i, a in enumerate(q):
        scored = []
        for j, b in enumerate(v):
            if metric == "cosine":
                size = np.sqrt(a @ a) * np.sqrt(b @ b)
                if size == 0:
                    continue
                scored.append((-round(float(a @ b / size), 9), j))
            else:
                scored.append((round(float(np.sqrt(((a - b) ** 2).sum())), 9), j))
        ranked = sorted(scored)[offset:offset + k]
        out += [(i, r + 1, j, round(abs(s) if metric == "l2" else -s, 6)) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


def rows(df):
    return sorted((r["question_id"], r["rank"], r["id"], round(r["score"], 6) + 0.0) for r in df.collect())


def data(seed=0, copies=60):
    """A third of the vectors are copies of one; one has no length."""
    rnd = np.random.default_rng(seed)
    held = rnd.normal(size=(120, 6))
    held = np.vstack([held, np.repeat(held[:1], copies, axis=0), np.zeros((1, 6))])
    asked = np.vstack([rnd.normal(size=(20, 6)), held[:3], np.zeros((1, 6))])
    return asked, held


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k,offset", [(2, 0), (1, 1), (300, 0)])
def test_scan_is_exact(spark, metric, k, offset):
    asked, held = data()
    found = search.top_k(frame(spark, asked, "question_id"), frame(spark, held), k, offset, metric)
    assert rows(found) == brute(asked, held, k, offset, metric)


def test_blocks_give_the_same_hits(spark, monkeypatch):
    asked, held = data(1)
    best = blocks.Best(np.float32(asked).astype(float), 3, 1, "cosine")
    monkeypatch.setattr(blocks, "BLOCK_SCORES", 50)
    best.add(np.arange(len(held))[:, None], np.float32(held).astype(float))
    found = {}
    for q, key, s in zip(best.q, best.keys[:, 0], best.s):
        found.setdefault(int(q), []).append((int(key), round(float(s), 6) + 0.0))
    expected = {}
    for q, _, j, s in brute(asked, held, 3):
        expected.setdefault(q, []).append((j, s + 0.0))
    assert found == expected


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_are_exact_with_a_hot_cell(spark, metric):
    asked, held = data(2)
    cells = search.build_cells(frame(spark, held), 8, metric)
    found = search.top_k_cells(frame(spark, asked, "question_id"), cells, 2, slice_rows=16)
    assert rows(found) == brute(asked, held, 2, 0, metric)


def test_cells_with_more_hits_than_vectors(spark):
    asked, held = data(3, copies=0)
    cells = search.build_cells(frame(spark, held[:10]), 4)
    found = search.top_k_cells(frame(spark, asked, "question_id"), cells, 50)
    assert rows(found) == brute(asked, held[:10], 50)


def test_large_question_tables_go_by_blocks(spark):
    asked, held = data(4)
    questions = frame(spark, asked, "question_id")
    assert not search.fits_broadcast(questions, limit=100)
    found = search.top_k(questions, frame(spark, held), 2, broadcast_bytes=4_000)
    assert rows(found) == brute(asked, held, 2)


def test_ties_at_nine_decimals_and_long_vectors_are_the_same_in_blocks(spark):
    schema = "question_id bigint, embedding array<double>"
    held = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 2e-5]), (3, [0.0, 1.0])], schema.replace("question_", ""))
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(8)] + [(8, None)], schema)
    for size in (64, 1 << 20):
        found = search.top_k(asked, held, 1, broadcast_bytes=size).collect()
        assert sorted((r["question_id"], r["id"]) for r in found) == [(i, 1) for i in range(8)]
    assert search.fits_broadcast(spark.createDataFrame([(1, None), (2, [])], schema))


def test_probing_all_cells_is_exact_and_recall_is_reported(spark):
    asked, held = data(5)
    questions, vectors = frame(spark, asked, "question_id"), frame(spark, held)
    cells = search.build_cells(vectors, 6)
    exact = search.top_k(questions, vectors, 2)
    assert search.recall(search.top_k_cells(questions, cells, 2, n_probe=6), exact).first()["recall"] == 1.0
    one = search.recall(search.top_k_cells(questions, cells, 2, n_probe=1), exact).first()
    assert 0.3 < one["recall"] <= 1.0 and one["expected"] == 46


def test_vectors_with_nan_are_no_hits(spark):
    held = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [0.5, 1.0])], "id bigint, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [float("inf"), 0.0])], "question_id bigint, embedding array<float>")
    assert [(r["question_id"], r["id"]) for r in search.top_k(asked, held, 2).collect()] == [(7, 2)]


def test_two_part_keys_break_ties(spark):
    held = spark.createDataFrame([(2, 0, [1.0, 0.0]), (1, 5, [1.0, 0.0]), (1, 3, [2.0, 0.0])], "d bigint, s int, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "question_id bigint, embedding array<float>")
    found = search.top_k(asked, held, 3, keys=("d", "s")).orderBy("rank").collect()
    assert [(r["d"], r["s"]) for r in found] == [(1, 3), (1, 5), (2, 0)]


def test_empty_sides(spark):
    asked, held = data()
    none = frame(spark, held).where("id < 0")
    assert search.top_k(frame(spark, asked, "question_id"), none, 2).count() == 0
    assert search.top_k(frame(spark, asked, "question_id"), none, 2, small=False).count() == 0
    assert search.top_k(none.withColumnRenamed("id", "question_id"), frame(spark, held), 2).count() == 0


def test_no_cross_join_in_the_plan(spark):
    asked, held = data()
    questions, vectors = frame(spark, asked, "question_id"), frame(spark, held)
    cells = search.build_cells(vectors, 4)
    for df in (search.top_k(questions, vectors, 2), search.top_k_cells(questions, cells, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_unknown_metric(spark):
    asked, held = data()
    with pytest.raises(ValueError):
        search.top_k(frame(spark, asked, "question_id"), frame(spark, held), 2, metric="dot")


def test_wrong_dimension_fails(spark):
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, embedding array<float>")
    with pytest.raises(Exception, match="expected 2 values"):
        emb.check_dimension(mixed, 2).collect()


def test_column_functions(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    found = rows.select(vx.cosine(a, b), vx.manhattan(a, b), vx.euclid(a, b)).collect()
    assert found[0][0] == pytest.approx(0.96) and found[0][1] == 2.0 and found[0][2] == pytest.approx(2 ** 0.5)
    assert found[1][0] is None


def test_default_vector(spark):
    texts = spark.createDataFrame([(1, "A a\n b"), (2, "  "), (3, None)], "id int, split string")
    found = [r["embedding"] for r in emb.embed(texts, dim=8).orderBy("id").collect()]
    assert sum(x * x for x in found[0]) == pytest.approx(1.0, abs=1e-6)
    assert found[1] == found[2] == [0.0] * 8
    places = sorted(x for x in found[0] if x)
    assert places == pytest.approx([0.4472136, 0.8944272], abs=1e-6)


def test_metadata(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "id int, n int, t string")
    built = emb.with_metadata(rows, ["n", "t"])
    found = built.orderBy("id").select(emb.metadata_field("n"), emb.metadata_field("t")).collect()
    assert [tuple(r) for r in found] == [("", "x"), ("5", "")]
    variant = emb.metadata_variant(built).select(F.variant_get("metadata", "$.t", "string")).collect()
    assert sorted(r[0] for r in variant) == ["", "x"]


def test_blocks_are_measured_after_the_cut(spark):
    asked = frame(spark, np.ones((64, 4)), "question_id")
    blocks = search._fitting_blocks(asked, 2, 8 * 4 * 20, "question_id", "embedding")
    sizes = asked.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(blocks))).count().collect()
    assert max(r["count"] for r in sizes) <= 20
    one = asked.withColumn("question_id", F.lit(1).cast("bigint"))
    with pytest.raises(ValueError):
        search._fitting_blocks(one, 2, 8 * 4 * 20, "question_id", "embedding")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_most_pairs_are_compared_by_one_product(monkeypatch, metric):
    rnd = np.random.default_rng(4)
    asked, held = np.float32(rnd.normal(size=(300, 8))).astype(float), np.float32(rnd.normal(size=(4000, 8))).astype(float)
    held[1000:3000] = held[7]  # equal vectors
    asked[5] = held[7]
    scored = []
    every, some = blocks._scores, blocks._pair_scores
    monkeypatch.setattr(blocks, "_scores", lambda q, v, m: scored.append(len(q) * len(v)) or every(q, v, m))
    monkeypatch.setattr(blocks, "_pair_scores", lambda q, v, m: scored.append(len(q)) or some(q, v, m))
    best = blocks.Best(asked, 3, 1, metric)
    best.add(np.arange(len(held))[::-1, None], held[::-1])
    found = sorted((int(q), int(key), round(abs(float(s)), 6)) for q, key, s in zip(best.q, best.keys[:, 0], best.s))
    assert found == sorted((i, j, abs(s)) for i, _, j, s in brute(asked, held, 3, 0, metric))
    assert sum(scored) < 0.03 * len(asked) * len(held)


def test_one_pass_takes_many_blocks_and_many_questions_spread_the_vectors(spark, monkeypatch):
    asked, held = data(5)
    seen, scan = [], search.top_k_scan

    def counted(questions, vectors, *rest):
        seen.append(vectors.rdd.getNumPartitions())
        return scan(questions, vectors, *rest)

    monkeypatch.setattr(search, "top_k_scan", counted)
    monkeypatch.setattr(search, "DEAL_BYTES", 1)
    questions, vectors = frame(spark, asked, "question_id"), materialize(frame(spark, held).coalesce(1), "held")
    assert rows(search.top_k(questions, vectors, 2, broadcast_bytes=5 * 48)) == brute(asked, held, 2)
    assert seen == [4]
    monkeypatch.setattr(search, "PASS_BYTES", 3 * 5 * 48)
    assert rows(search.top_k(questions, vectors, 2, broadcast_bytes=5 * 48)) == brute(asked, held, 2)
    assert 2 < len(seen) < 9 and min(seen[1:]) > 1
