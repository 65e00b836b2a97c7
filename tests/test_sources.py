import json

import pytest
from pyspark.sql import functions as F

from corpusq.operators import embedding as emb
from corpusq.plans import corpus
from corpusq.sources import readers, sinks
from corpusq.streaming.ingest import ingest_pages


def test_csv_keeps_texts(spark, tmp_path):
    values = ['quote " and "" two', "comma, and\nline\r\nend", "back\\slash \\\" x", " spaces ", "", None, "é\t;", '"', "\\"]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), "id int, t string")
    assert [r["t"] for r in back.orderBy("id").collect()] == values


def test_csv_errors_are_raised(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "none"), "id int").collect()
    (tmp_path / "bad.csv").write_text("id\nx\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), "id int").collect()


def test_record_arrays_and_lines(spark, tmp_path):
    bank = [{"question": "a", "answer": "b"}, {"question": "c\nd", "answer": None}]
    (tmp_path / "bank.json").write_text(json.dumps(bank, indent=2))
    found = readers.read_records(spark, str(tmp_path / "bank.json"), readers.QUESTION_SCHEMA).collect()
    assert [(r["question"], r["answer"]) for r in found] == [("a", "b"), ("c\nd", None)]
    (tmp_path / "bank.jsonl").write_text("\n".join(json.dumps(b) for b in bank))
    assert readers.read_records(spark, str(tmp_path / "bank.jsonl"), lines=True).count() == 2


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("list; song ;by;")
    words = readers.read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert sorted(r["word"] for r in words.collect()) == ["by", "list", "song"]
    more = sinks.add_stop_words(words, spark.createDataFrame([("mysong",)], "word string"))
    left = sinks.delete_stop_words(more, spark.createDataFrame([("song",)], "word string"))
    assert sorted(r["word"] for r in left.collect()) == ["by", "list", "mysong"]


def test_whole_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.txt").write_text("three")
    one = readers.read_texts(spark, str(tmp_path / "a.txt")).collect()
    assert [r["content"] for r in one] == ["one\ntwo\n"] and one[0]["path"].endswith("a.txt")
    assert readers.read_texts(spark, str(tmp_path)).count() == 2


def test_bindings(spark):
    response = {"results": {"bindings": [{"r": {"value": "A", "type": "uri"}}, {"r": {"value": "B"}, "x": {"value": "1"}}]}}
    rows = spark.createDataFrame([(1, json.dumps(response)), (2, "not json")], "id int, body string")
    assert sorted(tuple(r) for r in readers.bindings(rows, "body", "r", "x").collect()) == [(1, "A", None), (1, "B", "1")]


def test_revisions(spark):
    def body(page, *stamps):
        return json.dumps({"query": {"pages": {str(page): {"revisions": [{"timestamp": t} for t in stamps]}}}})

    rows = spark.createDataFrame(
        [(1, body(1, "2024-03-01T00:00:00Z", "2020-01-01T10:20:30Z")), (2, body(9, "2024-01-01T00:00:00Z")), (3, "x")],
        "page_id bigint, body string",
    )
    found = readers.revision_times(rows, "body").collect()
    assert [(r["page_id"], str(r["creation_date"]), str(r["last_modified"])) for r in found] == [
        (1, "2020-01-01 10:20:30", "2024-03-01 00:00:00")
    ]
    assert readers.revision_rows(rows, "body").count() == 2
    rejects = {r["page_id"]: r["reason"] for r in readers.rejected_responses(rows, "body").collect()}
    assert rejects == {2: "no revisions for the page", 3: "not a revision response"}


def test_vector_table_in_the_catalog(spark):
    sinks.create_vector_table(spark, "vec_t")
    sinks.create_vector_table(spark, "vec_t")
    rows = spark.createDataFrame([(1, [1.0], "{}")], "id bigint, embedding array<float>, metadata string")
    rows.write.mode("append").insertInto("vec_t")
    assert readers.read_vectors(spark, "vec_t").count() == 1
    sinks.drop_vector_table(spark, "vec_t")
    sinks.drop_vector_table(spark, "vec_t")
    assert not spark.catalog.tableExists("vec_t")


def test_append_by_key(spark, tmp_path):
    path = str(tmp_path / "vec")
    schema = "page_id int, section_no int, section string, split_id int, n int"
    first = spark.createDataFrame([(1, 0, None, 0, 1), (1, 1, "A", 0, 2), (1, 1, "A", 0, 2), (1, 3, "A", 0, 4)], schema)
    sinks.append_vectors(first, path, sinks.CHUNK_KEY)
    second = spark.createDataFrame([(1, 0, None, 0, 9), (1, 1, "A", 1, 3)], schema)
    sinks.append_vectors(second, path, sinks.CHUNK_KEY)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    sinks.append_vectors(second, path)
    assert spark.read.parquet(path).count() == 6


def test_pages_are_ingested_as_they_arrive(spark, tmp_path):
    schema = "page_id bigint, page_url string, title string, content string, creation_date timestamp_ntz, last_modified timestamp_ntz"
    source, table = str(tmp_path / "pages"), str(tmp_path / "vectors")

    def arrive(*rows):
        typed = spark.createDataFrame([(i, f"u{i}", "t", c, None, None) for i, c in rows], schema)
        typed.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest_pages(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        return {(r["page_id"], r["section_no"]): r["metadata"]["split"] for r in spark.read.parquet(table).collect()}

    assert arrive((1, "== A ==\nx\ny")) == {(1, 0): "x y"}
    assert arrive((2, "z"), (1, "== A ==\nx\ny")) == {(1, 0): "x y", (2, 0): "z"}
    assert spark.read.parquet(table).count() == 2


def test_corpus_rows_have_the_stated_fields(spark):
    pages = spark.createDataFrame([(1, "u", "t", "a", None, None)], "page_id bigint, page_url string, title string, content string, creation_date timestamp_ntz, last_modified timestamp_ntz")
    row = corpus.vectors(corpus.chunks(corpus.sections(pages))).first()
    assert tuple(row["metadata"].asDict()) == corpus.METADATA and len(row["embedding"]) == 64


def test_record_arrays_one_file_for_each_group(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = [(i, None if i == 3 else f'text "{i}"\n, [x]') for i in range(7)]
    df = spark.createDataFrame(rows, "id bigint, answer string")
    sinks.write_records(df, path, F.floor(F.col("id") / 3))
    files = [f for f in (tmp_path / "arrays").glob("part-*") if f.stat().st_size]
    assert len(files) == 3 and all(isinstance(json.loads(f.read_text()), list) for f in files)
    back = readers.read_records(spark, path, "id bigint, answer string")
    assert sorted(map(tuple, back.collect())) == rows


def test_texts_as_files(spark, tmp_path):
    path = str(tmp_path / "texts")
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "")], "id bigint, body string")
    sinks.write_texts(df, path, "id", "body")
    found = {r["path"].split("id=")[1].split("/")[0]: r["content"] for r in readers.read_texts(spark, path).collect()}
    assert found["1"] == "one\ntwo\n"


def test_metadata_with_fields_of_its_own_for_each_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", 5), (2, None, None), (3, "t", None)], "id bigint, source string, quality int")
    path = str(tmp_path / "variant")
    emb.open_metadata(df, ["source", "quality"]).select("id", "metadata").write.parquet(path)
    held = spark.read.parquet(path)
    fields = held.select("id", emb.variant_field("source").alias("s"), emb.variant_field("quality", "int").alias("q"), emb.variant_field("source", "int").alias("wrong"))
    assert sorted(map(tuple, fields.collect())) == [(1, "s", 5, None), (2, None, None, None), (3, "t", None, None)]
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
