"""Places where a model is plugged in, each with a default that needs none.

A hook takes and returns Columns. The defaults are built-in expressions; the
`model_*` makers wrap a model in an Arrow-batched UDF that loads it once per
Python worker, not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions import vectors as vx


@dataclass(frozen=True)
class Sampling:
    """Settings handed to a text model. Fixed values of the question service."""

    max_tokens: int = 2500
    temperature: float = 0.1
    top_p: float = 0.95
    repeat_penalty: float = 1.2
    top_k: int = 100
    echo: bool = True


def default_embed(dim: int = 64) -> Callable[[Column], Column]:
    return lambda text: vx.hashed_vector(text, dim)


def default_tokens(special_tokens: int = 0) -> Callable[[Column], Column]:
    """Word count, plus the tokens an encoder adds at the ends if asked for."""
    return lambda text: tx.word_count(text) + F.lit(special_tokens)


def default_generate(prompt: Column, best: Column) -> Column:
    """Echo the prompt, then answer with the best chunk; the shape a model that
    echoes its input returns."""
    return F.concat(prompt, F.lit(" "), F.coalesce(best, F.lit("")))


def default_classify(text: Column) -> Column:
    return tx.text_class(text)


def _batched(load: Callable[[], Callable], returns: str):
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())))

    return run


def model_embed(load: Callable[[], Callable]) -> Callable[[Column], Column]:
    """`load()` returns `texts -> vectors`."""
    return _batched(load, "array<float>")


def model_tokens(load: Callable[[], Callable]) -> Callable[[Column], Column]:
    """`load()` returns `texts -> token counts`."""
    return _batched(load, "int")


def model_classify(load: Callable[[], Callable]) -> Callable[[Column], Column]:
    """`load()` returns `texts -> class names`."""
    return _batched(load, "string")


def model_generate(load: Callable[[], Callable], sampling: Sampling = Sampling()):
    """`load()` returns `(prompts, **sampling) -> texts`."""
    settings = asdict(sampling)

    def bound() -> Callable:
        model = load()
        return lambda prompts: model(prompts, **settings)

    run = _batched(bound, "string")
    return lambda prompt, best: run(prompt)
