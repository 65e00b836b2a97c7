import pytest
from pyspark.sql import functions as F

from corpusq.sources import vector_table as vt

SCHEMA = "page_id long, section_no int, split_id int, text string, embedding array<float>"


def rows(spark, items):
    return spark.createDataFrame([(p, s, c, t, [1.0, 2.0]) for p, s, c, t in items], SCHEMA)


def held(spark, path):
    return sorted(((r["page_id"], r["section_no"], r["split_id"], r["text"], r["batch_id"]) for r in vt.read_rows(spark, path).collect()), key=str)


FIRST = [(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 1, 0, "again"), (2, 0, 0, "c"), (None, 0, 0, "null page")]
SECOND = [(1, 0, 0, "other text"), (2, 0, 1, "d"), (3, 0, 0, "e"), (None, 0, 0, "null page")]


def test_each_key_once_and_reruns_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        vt.load_batch(rows(spark, FIRST).repartition(3), path, "one", buckets=8, dim=2)
    vt.load_batch(rows(spark, SECOND), path, "two", buckets=8)
    expected = [(1, 0, 0, "a", "one"), (1, 1, 0, "again", "one"), (2, 0, 0, "c", "one"), (None, 0, 0, "null page", "one"), (2, 0, 1, "d", "two"), (3, 0, 0, "e", "two")]
    assert held(spark, path) == sorted(expected, key=str)
    vt.load_batch(rows(spark, SECOND), path, "two", buckets=8)
    assert held(spark, path) == sorted(expected, key=str)
    done = {(r["batch_id"], r["given"], r["added"]) for r in vt.commits(spark, path).collect()}
    assert done == {("one", 5, 4), ("two", 4, 2)}
    vt.compact(spark, path, str(tmp_path / "c"))
    assert [r[:4] for r in held(spark, str(tmp_path / "c"))] == sorted((r[:4] for r in expected), key=str)


def test_a_load_without_commit_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    vt.load_batch(rows(spark, FIRST), path, "one", buckets=8)
    lost = rows(spark, [(9, 0, 0, "half")]).withColumn("bucket", vt.bucket_of(vt.CHUNK_KEY, 8)).withColumn("batch_id", F.lit("two"))
    lost.write.mode("append").partitionBy("bucket", "batch_id").parquet(f"{path}/rows")  # written, never committed
    assert 9 not in {r[0] for r in held(spark, path)}
    vt.load_batch(rows(spark, [(9, 0, 0, "whole"), (9, 0, 1, "more")]), path, "two", buckets=8)
    assert {r[3] for r in held(spark, path) if r[0] == 9} == {"whole", "more"}


def test_a_rerun_reads_only_its_own_buckets(spark, tmp_path):
    path = tmp_path / "t"
    vt.load_batch(rows(spark, [(i, 0, 0, "x") for i in range(200)]), str(path), "one", buckets=16)
    again = rows(spark, [(3, 0, 0, "x"), (1_003, 0, 0, "x")])
    own = {r[0] for r in again.select(vt.bucket_of(vt.CHUNK_KEY, 16)).collect()}
    spoiled = [f for f in (path / "rows").glob("bucket=*/*/*.parquet") if int(f.parts[-3].split("=")[1]) not in own]
    assert len(spoiled) > 10
    for f in spoiled:  # whoever reads another bucket fails
        f.write_bytes(b"not a table")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    for _ in range(2):
        vt.load_batch(again, str(path), "two", buckets=16)
    assert {(r["batch_id"], r["given"], r["added"]) for r in vt.commits(spark, str(path)).collect()} == {("one", 200, 200), ("two", 2, 1)}


def test_columns_of_the_table_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        vt.load_batch(rows(spark, FIRST).withColumn("bucket", F.lit(1)), str(tmp_path / "t"), "one")


def test_a_load_stores_its_rows_once_and_moves_them_once(spark, tmp_path, monkeypatch):
    stored, plans = [], []
    keep = vt.materialize
    monkeypatch.setattr(vt, "materialize", lambda df, name, *rest: plans.append(df._jdf.queryExecution().toString()) or stored.append(name) or keep(df, name, *rest))
    for name in ("one", "two"):
        vt.load_batch(rows(spark, FIRST + SECOND), str(tmp_path / "t"), name, buckets=8)
    assert stored == ["batch", "batch"] and not any("Exchange" in p for p in plans)
    assert {(r["batch_id"], r["given"], r["added"]) for r in vt.commits(spark, str(tmp_path / "t")).collect()} == {("one", 9, 6), ("two", 9, 0)}


def test_a_load_without_rows_is_committed(spark, tmp_path):
    path = str(tmp_path / "t")
    vt.load_batch(rows(spark, FIRST).where("false"), path, "none", buckets=8)
    vt.load_batch(rows(spark, FIRST), path, "one", buckets=8)
    vt.load_batch(rows(spark, FIRST).where("false"), path, "last", buckets=8)
    assert {(r["batch_id"], r["added"]) for r in vt.commits(spark, path).collect()} == {("none", 0), ("one", 4), ("last", 0)}
    assert len(held(spark, path)) == 4
