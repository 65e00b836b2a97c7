"""Batch evaluation of a question bank: retrieval once, then the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.operators.answers import EVALUATION_PROMPT, with_answer
from corpusq.operators.evaluation import with_answers


def evaluate_bank(
    bank: DataFrame, retrieved: DataFrame, topic: str, best_only: bool = False, generate_hook=None,
    template: str = EVALUATION_PROMPT,
) -> DataFrame:
    """The bank with `answer_retreiver`, `retreiver_answers12` and
    `qasystem_answers`. `retrieved` comes from one search, so both retrieval
    columns hold the same text: the k best chunks joined, or the best alone."""
    if best_only:
        retrieved = retrieved.withColumn("context", F.col("best"))
    answered = with_answer(retrieved, topic, template, generate_hook=generate_hook, extract=tx.answer_matched)
    columns = answered.select(
        "question_id", F.col("context").alias("answer_retreiver"), F.col("context").alias("retreiver_answers12"),
        F.col("answer").alias("qasystem_answers"),
    )
    return with_answers(bank.drop("embedding"), columns)
