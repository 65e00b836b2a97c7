import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusq.llm import quality_qda as qda
from corpusq.llm import quality_rules as q

TEXTS = [
    None, "", " \t\n", "one two", "a b c d e f g h " * 2 + "tail", "x " * 100, "same line\nsame line\n\n  \nother\nsame line",
    "the quick brown fox jumps over the lazy dog and runs far away from all of them today again " * 3 + "end é😀 ß",
    " ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(f"w{i}" for i in range(50)), "#a *b $c %d &e |f <g> !!" * 5,
    "tab\tvertical\x0bform\x0cfeed\rreturn nbsp\xa0joined " * 4,
]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_brute_force(make):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])]
    found = q.ledger(make(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r["doc_id"], *[r[n] for n in names]) for r in found)
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_policies_and_ablations(make):
    held = q.ledger(make(list(enumerate(TEXTS))))
    rows = q.apply_policies(held, (q.BASE, q.STRICT)).collect()
    for r in rows:
        n, _, _, _, repeated = brute(TEXTS[r["doc_id"]])
        assert r[q.BASE.version] == (not (n < 20 or 100 * repeated > 30 * n))
        assert r[q.STRICT.version] == (r["failures"] & q.STRICT.mask() == 0)
    for r in q.ablations(held, q.STRICT).collect():
        bit = 1 << r["bit"]
        assert r["failed"] == sum(bool(x["failures"] & bit) for x in rows)
        assert r["kept_without"] == sum(x["failures"] & q.STRICT.mask() & ~bit == 0 for x in rows)


def test_keep_returns_whole_rows(make):
    docs = make([*enumerate(TEXTS), (8, TEXTS[8])])
    kept = q.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        r["doc_id"] for r in q.apply_policies(q.ledger(docs), (q.STRICT,)).where(F.col(f"`{q.STRICT.version}`")).collect()
    )
    assert q.keep(make([])).collect() == [] and q.ledger(make([])).collect() == []


def test_discriminant_equals_numpy(spark, make):
    docs = make([*enumerate(TEXTS), (None, "null id " * 30), *[(100 + i, f"clean prose number {i} goes on " * (5 + i % 7)) for i in range(60)]])
    labels = spark.createDataFrame([(i, int(i >= 100), "x") for i in [*range(len(TEXTS)), *range(100, 160)]] + [(5, None, "x")], "doc_id long, quality int, text string")
    found = qda.classify(docs, labels).collect()
    x = {r["doc_id"]: np.array(r["x"]) for r in qda.statistics(docs, "text", "doc_id").collect()}
    out = {r["doc_id"]: r["held_out"] for r in found}
    train = {c: np.array([x[i] for i in x if i is not None and not out[i] and int(i >= 100) == c]) for c in (0, 1)}
    n = sum(map(len, train.values()))
    scatter = sum(np.cov(t.T, bias=True) * len(t) for t in train.values()) / n

    def density(c, v):
        own = (1 - qda.TOWARDS_POOLED) * np.cov(train[c].T, bias=True) + qda.TOWARDS_POOLED * scatter
        s = (1 - qda.TOWARDS_DIAGONAL) * own + qda.TOWARDS_DIAGONAL * np.diag(np.diag(own)) + qda.FLOOR * np.eye(len(v))
        d = v - train[c].mean(axis=0)
        return np.log(len(train[c]) / n) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d)

    for r in found:
        gap = np.clip(density(1, x[r["doc_id"]]) - density(0, x[r["doc_id"]]), -700, 700)
        assert abs(r["score"] - 1 / (1 + np.exp(-gap))) < 1e-6
        assert r["predicted"] == int(r["score"] >= 0.7)
    assert not out[None]


def test_discriminant_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qda.classify(make([(1, "a"), (2, None)]), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scores = {r["score"] for r in qda.classify(make([(1, "a b"), (2, None)]), one).collect()}
    assert scores <= {0.5, 1.0}
    assert qda.classify(make([]), none).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = qda.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
