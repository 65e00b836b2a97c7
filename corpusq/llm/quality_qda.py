"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each whole text is measured once (the measurements of the rule ledger), and the statistics are logarithms of sizes and rates.
Class means and covariances come from sums and sums of products over all training rows, combined in the tasks, so
the fit reads every label and gathers one row for each class. Covariances are shrunk towards the pooled covariance
and towards its diagonal. Cholesky factors are computed once, and a score is the logistic of the difference of the two log densities (half the
difference of the Mahalanobis distances and of the log determinants) and of the log priors.

Null and empty texts have statistics like any other. A class without training rows gives the score of the other (1 or 0);
no training rows at all give 0.5. Documents with a null id are scored and never trained on. A label that is null
is not used; repeated labels of one id count each. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.quality_rules import measure
from corpusq.session import materialize

TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.1
FLOOR = 1e-3  # least variance of a statistic
CUT = 0.7
FOLDS, HELD_OUT = 4, 2

STATISTICS = (
    "size", "word_length", "symbols", "exclamations", "upper", "dup_lines", "repeats", "adjacent", "line_length",
)


def statistics(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """`keys` and the array `x` of transformed statistics of every whole text."""

    def rate(n: str, of: str) -> Column:
        return F.log((F.col(n) + 0.5) / (F.col(of) + 1.0))

    words = F.col("n_words")
    x = {
        "size": F.log1p(words),
        "word_length": F.log((F.col("word_chars") + 1.0) / (words + 1.0)),
        "symbols": rate("n_symbols", "n_words"),
        "exclamations": rate("n_exclamations", "n_words"),
        "upper": rate("n_upper", "word_chars"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "adjacent": rate("n_adjacent", "n_words"),
        "line_length": F.log((words + 1.0) / (F.col("n_lines") + 1.0)),
    }
    return measure(docs, text, keys).select(*keys, F.array(*[x[k] for k in STATISTICS]).alias("x"))


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant. Missing classes are absent."""

    classes: dict[int, tuple[float, np.ndarray, np.ndarray, float]]

    def density(self, label: int, x: str) -> Column:
        """Log prior and log density of a class, without the constant both classes share."""
        prior, mean, inverse, log_det = self.classes[label]
        centred = [F.get(F.col(x), F.lit(j)) - F.lit(float(m)) for j, m in enumerate(mean)]
        distance = F.lit(0.0)
        for i, row in enumerate(inverse):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(float(row[j])) * centred[j]
            distance = distance + F.pow(z, F.lit(2.0))
        return F.lit(prior - 0.5 * log_det) - 0.5 * distance

    def score(self, x: str = "x") -> Column:
        """Probability of class 1."""
        if not self.classes:
            return F.lit(0.5)
        if len(self.classes) == 1:
            return F.lit(float(next(iter(self.classes))))
        gap = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), self.density(1, x) - self.density(0, x)))
        return 1.0 / (1.0 + F.exp(-gap))


def fit(rows: DataFrame, x: str = "x", label: str = "label", pooled: float = TOWARDS_POOLED, diagonal: float = TOWARDS_DIAGONAL) -> Model:
    """Fit on all rows `(x, label)`, label 0 or 1."""
    k = len(STATISTICS)
    v = [F.get(F.col(x), F.lit(j)) for j in range(k)]
    # moments about the mean of all rows, so that sums of squares keep their digits
    centre = rows.agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(v)]).first()
    middle = np.array([c if c is not None else 0.0 for c in centre])
    d = [c - F.lit(float(m)) for c, m in zip(v, middle)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = rows.groupBy(label).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s{j}") for j, c in enumerate(d)],
        *[F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()
    held, scatter, total = {}, np.zeros((k, k)), 0
    for r in sums:
        mean = np.array([r[f"s{j}"] for j in range(k)]) / r["n"]
        product = np.zeros((k, k))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"]
        own = product - r["n"] * np.outer(mean, mean)
        held[int(r[label])] = (r["n"], mean, own / r["n"])
        scatter, total = scatter + own, total + r["n"]
    classes = {}
    for name, (n, mean, covariance) in held.items():
        shared = (1 - pooled) * covariance + pooled * scatter / total
        shrunk = (1 - diagonal) * shared + diagonal * np.diag(np.diag(shared)) + FLOOR * np.eye(k)
        factor = np.linalg.cholesky(shrunk)
        inverse = np.linalg.inv(factor)
        classes[name] = (math.log(n / total), mean + middle, inverse, 2 * float(np.log(np.diag(factor)).sum()))
    return Model(classes)


def part_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted. Held-out ids are never trained on."""
    held = materialize(statistics(docs, text, "doc_id"), "statistics")
    out = F.coalesce(part_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~out)
    model = fit(materialize(held.join(known, "doc_id").select("x", "label"), "training"))
    score = model.score()
    return held.select("doc_id", out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= cut, 1).otherwise(0)
    )
