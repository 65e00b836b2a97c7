import pytest
from pyspark.sql import functions as F

from corpusq.functions import hooks
from corpusq.functions import text as tx
from corpusq.operators import answers
from corpusq.plans.evaluation import evaluate_bank
from corpusq.sources.sinks import answer_records


@pytest.fixture(scope="module")
def store(spark):
    rows = [(1, [1.0, 0.0], "first", "u1", "t1"), (2, [0.9, 0.1], "second", "u2", "t2"), (3, [0.0, 1.0], "third", "u1", "t1")]
    chunks = spark.createDataFrame(rows, "id bigint, embedding array<float>, split string, page_url string, title string")
    asked = spark.createDataFrame(
        [(1, "q one", [1.0, 0.0]), (2, "q two", [0.0, 2.0]), (3, "q none", [0.0, 0.0])],
        "question_id bigint, question string, embedding array<float>",
    )
    return asked, chunks.select("id", "embedding"), chunks.drop("embedding")


def test_retrieve(spark, store):
    found = {r["question_id"]: r for r in answers.retrieve(*store).collect()}
    assert found[1]["context"] == "first second" and found[1]["best"] == "first"
    assert found[1]["urls"] == ["u1", "u2"] and found[2]["titles"] == ["t1", "t2"]
    assert found[3]["context"] == "" and found[3]["best"] is None and found[3]["urls"] == []


def test_answer_with_default_hook(spark, store):
    got = answers.answer(answers.retrieve(*store), "topic")
    assert {r["question_id"]: r["answer"] for r in got.collect()} == {1: " first", 2: " third", 3: " "}
    records = {r["question_id"]: r["record"] for r in answer_records(got).collect()}
    assert records[1] == '{"answer":" first","urls":["u1","u2"],"titles":["t1","t2"]}'


def test_answer_with_a_model(spark, store):
    def load():
        return lambda prompts, **settings: [f"{p}{settings['top_k']} words: {len(p.split())}" for p in prompts]

    got = answers.answer(
        answers.retrieve(*store), "topic", template="[INST]{context}|{question}[/INST]",
        generate_hook=hooks.model_generate(load), extract=tx.answer_matched,
    )
    assert {r["question_id"]: r["answer"] for r in got.collect()}[2] == "100 words: 3"


def test_role_prompt(spark, store):
    found = answers.with_prompt(answers.retrieve(*store), "air", answers.ROLE_PROMPT).where("question_id = 1").first()
    assert found["prompt"] == "SYSTEM: You are an assistant expert on air.\n\nCONTEXT: first second\n\nUSER: q one\n\nASSISTANT:\n\n"


def test_instruction_prompts():
    service, plain = answers.INSTRUCTION_PROMPT.split("\n"), answers.EVALUATION_PROMPT.split("\n")
    assert [line.removeprefix("    ") for line in service] == plain and service[1].startswith("    You")
    assert plain[0] == "[INST] <<SYS>>" and plain[-2:] == ["</SYS>>", "{question}[/INST]"]
    assert len({answers.instruction_prompt(o) for o in answers.OPENINGS}) == 4


def test_evaluation_columns(spark, store):
    asked = store[0]
    found = answers.retrieve(*store, sep=answers.EVALUATION_SEPARATOR)
    joined = {r["question_id"]: r for r in evaluate_bank(asked, found, "t").collect()}
    assert joined[1]["answer_retreiver"] == joined[1]["retreiver_answers12"] == "first. second"
    assert joined[1]["qasystem_answers"] == "first"
    best = {r["question_id"]: r for r in evaluate_bank(asked, found, "t", best_only=True).collect()}
    assert best[1]["answer_retreiver"] == "first" and best[3]["answer_retreiver"] is None


def test_model_hooks(spark):
    rows = spark.createDataFrame([("ab",)], "t string")
    vector = hooks.model_embed(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    label = hooks.model_classify(lambda: lambda texts: ["L" for _ in texts])
    assert rows.select(vector(F.col("t")), label(F.col("t"))).first()[:] == ([2.0, 1.0], "L")
