"""From questions to answers: retrieval, prompt, model hook, extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions.hooks import default_generate
from corpusq.operators.search import fits_broadcast, top_k
from corpusq.session import join_small, materialize

# Prompt formats, context separators and hits per question.
OPENINGS = {
    "concise": "You are an assistant that always answer concisely, without introductory sentences and be helpfully as possible, while being safe.",
    "helpful": "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.",
    "brief": "You are a helpful, respectful and honest assistant. Always answer briefly and concisely, without introductory sentences and be helpfully as possible, while being safe.",
    "plain": "You are a helpful, respectful and honest assistant be helpfully as possible, while being safe.",
}
RULES = "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature. If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."
EXPERT = "also you are a {topic} expert, answer questions about {topic} as best as you can with this context {context}."
ROLE_PROMPT = """SYSTEM: You are an assistant expert on {topic}.

CONTEXT: {context}

USER: {question}

ASSISTANT:

"""
SERVICE_SEPARATOR = " "
EVALUATION_SEPARATOR = ". "
HITS = 2


def instruction_prompt(opening: str = "concise", indent: str = "") -> str:
    """The instruction template with one of the openings. The service indents
    its system lines by four spaces, the evaluation does not."""
    system = "".join(f"\n{indent}{line}" for line in (f"{OPENINGS[opening]} {RULES}", EXPERT, "</SYS>>"))
    return f"[INST] <<SYS>>{system}\n{{question}}[/INST]"


INSTRUCTION_PROMPT = instruction_prompt(indent="    ")
EVALUATION_PROMPT = instruction_prompt()


def attach(hits: DataFrame, chunks: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Hits with the text columns of their chunk. Ranking was done on keys and
    vectors alone; texts are read only here. If `small` says that the questions are few, the
    number of hits is checked, and they are broadcast if it is small as well."""
    if small:
        return join_small(chunks, hits, list(keys))
    return chunks.join(hits, list(keys))


def gather(
    questions: DataFrame, hits: DataFrame, chunks: DataFrame, small: bool, sep: str = SERVICE_SEPARATOR,
    keys: Sequence[str] = ("id",), question_id: str = "question_id",
) -> DataFrame:
    """`(question_id, question, context, best, urls, titles)` from ranked hits.

    Lists are in rank order and keep repeats; the group of a question is at most
    k rows. A question without hits has an empty context.
    """
    found = attach(hits, chunks.select(*keys, "split", "page_url", "title"), keys, small)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "split", "page_url", "title")))
    lists = found.groupBy(question_id).agg(ordered.alias("_hits"))
    none = F.array().cast("array<string>")
    return questions.select(question_id, "question").join(lists, question_id, "left").select(
        question_id,
        "question",
        F.array_join(F.coalesce(F.col("_hits.split"), none), sep).alias("context"),
        F.try_element_at(F.col("_hits.split"), F.lit(1)).alias("best"),
        F.coalesce(F.col("_hits.page_url"), none).alias("urls"),
        F.coalesce(F.col("_hits.title"), none).alias("titles"),
    )


def retrieve(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = HITS, sep: str = SERVICE_SEPARATOR,
    keys: Sequence[str] = ("id",), question_id: str = "question_id", **search,
) -> DataFrame:
    """Search and gather. `questions` has an `embedding`, `vectors` has keys and
    `embedding`, `chunks` has keys, `split`, `page_url` and `title`."""
    small = fits_broadcast(questions)
    hits = materialize(top_k(questions, vectors, k, question_id=question_id, keys=keys, small=small, **search), "hits")
    return gather(questions, hits, chunks, small, sep, keys, question_id)


def with_prompt(retrieved: DataFrame, topic: str, template: str = INSTRUCTION_PROMPT, context: str = "context") -> DataFrame:
    """Add the prompt of each question."""
    return retrieved.withColumn(
        "prompt",
        tx.fill_template(
            template, topic=F.lit(topic), context=F.coalesce(F.col(context), F.lit("")), question=F.col("question")
        ),
    )


def with_answer(
    retrieved: DataFrame, topic: str, template: str = INSTRUCTION_PROMPT,
    generate_hook: Callable[[Column, Column], Column] | None = None,
    extract: Callable[[Column], Column] = tx.answer_after, context: str = "context",
) -> DataFrame:
    """Add the answer of each question: prompt, model hook, extraction."""
    generate = generate_hook or default_generate
    prompted = with_prompt(retrieved, topic, template, context)
    raw = prompted.withColumn("raw", generate(F.col("prompt"), F.col("best")))
    return raw.withColumn("answer", extract(F.col("raw"))).drop("prompt", "raw")


def answer(retrieved: DataFrame, topic: str, template: str = INSTRUCTION_PROMPT, **options) -> DataFrame:
    """`(question_id, question, answer, urls, titles)`; options as in `with_answer`."""
    return with_answer(retrieved, topic, template, **options).select(
        "question_id", "question", "answer", "urls", "titles"
    )
