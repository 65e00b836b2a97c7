import uuid

import numpy as np

from corpusq.operators import answers
from corpusq.sources import chunk_store as cs
from tests.test_search import frame


def chunks(spark, held):
    vectors = frame(spark, held).withColumnRenamed("id", "doc_id")
    return vectors.selectExpr("doc_id", "cast(doc_id % 3 as int) split_id", "embedding", "concat('text ', doc_id) split", "concat('url', doc_id) page_url", "'t' title")


def test_stored_chunks_give_the_same_answers(spark, tmp_path):
    rnd = np.random.default_rng(2)
    held, asked = rnd.normal(size=(80, 5)), rnd.normal(size=(9, 5))
    rows = chunks(spark, held)
    store = cs.write_chunk_store(rows, f"c{uuid.uuid4().hex}", str(tmp_path / "chunks"), ["doc_id", "split_id"], buckets=4)
    questions = frame(spark, asked, "question_id").selectExpr("question_id", "concat('q', question_id) question", "embedding")
    found = cs.retrieve_stored(questions, store, 3)
    plain = answers.retrieve(questions, rows, rows, 3, keys=["doc_id", "split_id"])
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    cs.drop_chunk_store(spark, store)
    assert not spark.catalog.tableExists(store.text_table)


def test_no_text_is_moved_for_the_join(spark, tmp_path):
    """Without broadcasts the hits are shuffled to the buckets of the texts, and the texts stay."""
    rows = chunks(spark, np.random.default_rng(3).normal(size=(60, 4)))
    store = cs.write_chunk_store(rows, f"c{uuid.uuid4().hex}", str(tmp_path / "chunks"), ["doc_id", "split_id"], buckets=4)
    hits = rows.selectExpr("doc_id as question_id", "cast(1 as int) rank", "doc_id", "split_id", "0.5 as score")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = answers.attach(hits, store.texts(spark), ["doc_id", "split_id"], False)
        plan = met._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "Bucketed: true" in plan and len(moved) == 1
        assert "page_url" not in plan[plan.index(moved[0]) :].split("FileScan")[0]  # it moves the hits
        assert met.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        cs.drop_chunk_store(spark, store)
