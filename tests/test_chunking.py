import time

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions.hooks import default_tokens, model_tokens
from corpusq.operators import chunking as ch
from corpusq.operators.rowid import with_batches, with_row_id


def rows_of(df, key="id"):
    found = {}
    for r in df.orderBy(key, "split_id").collect():
        found.setdefault(r[key], []).append((r["split_id"], r["split"], r["tokens"]))
    return found


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, content string")


def cut(text):
    text = re.sub(r"[ \t\n\r\f]+", " ", text).strip(" ")
    return re.split(r"(?<=[.!?]) ", text) if text else []


def by_sentence(text, n):
    s = cut(text)
    return [" ".join(s[i:i + n]) for i in range(0, len(s), n)]


def by_word(text, n):
    groups, held = [], 0
    for s in cut(text):
        size = len(s.split())
        if groups and held + size <= n:
            groups[-1].append(s)
            held += size
        else:
            groups.append([s])
            held = size
    return [" ".join(g) for g in groups]


def random_texts(n=150, seed=5):
    rnd = random.Random(seed)
    words = ["a", "bb", "c.", "d!", "e?", "ff.", "\n", "  "]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(n)]


def numbered(parts):
    return [(i, p, len(p.split())) for i, p in enumerate(parts)]


@pytest.mark.parametrize("n", [1, 4, 6])
def test_sentence_groups(spark, n):
    values = random_texts()
    found = rows_of(ch.chunk(texts(spark, values), split_length=n, max_tokens=None))
    assert found == {i: numbered(by_sentence(v, n)) for i, v in enumerate(values) if by_sentence(v, n)}


@pytest.mark.parametrize("n", [3, 10])
def test_word_groups(spark, n):
    values = random_texts(seed=6)
    found = rows_of(ch.chunk(texts(spark, values), split_by="word", split_length=n, max_tokens=None))
    assert found == {i: numbered(by_word(v, n)) for i, v in enumerate(values) if by_word(v, n)}


def test_limit_branch(spark):
    whole, long = " ".join(["w"] * 512), " ".join(["w"] * 513)
    found = rows_of(ch.chunk(texts(spark, [whole, long, "  spaced\n text  ", None, ""])))
    assert found[0] == [(0, whole, 512)]
    assert found[1] == [(0, long, 513)]  # one sentence, however long, stays whole
    assert found[2] == [(0, "  spaced\n text  ", 2)]  # a short text is kept as it is
    assert 3 not in found and found[4] == [(0, "", 0)]


def test_long_numeric_text_gives_nothing(spark):
    table = "\n".join(["1 2 3"] * 300)
    assert ch.chunk(texts(spark, [table])).count() == 0


def test_rejected_rows_have_a_reason(spark):
    found = ch.rejected(texts(spark, ["ok", None, " \n "])).orderBy("id").collect()
    assert [(r["id"], r["reason"]) for r in found] == [(1, "no text"), (2, "empty text")]


def test_token_hooks(spark):
    rows = texts(spark, ["a b c"])
    assert ch.chunk(rows, tokens=default_tokens(2)).first()["tokens"] == 5
    letters = model_tokens(lambda: lambda values: [len(v) for v in values])
    assert ch.chunk(rows, tokens=letters).first()["tokens"] == 5
    assert rows_of(ch.chunk(rows, tokens=letters, max_tokens=4)) == {0: [(0, "a b c", 5)]}


def test_languages(spark):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "b", "fr")], "id int, content string, lang string")
    assert [r["id"] for r in ch.chunk(rows, lang="lang", valid_languages=("en",)).collect()] == [1]


@pytest.mark.parametrize("tokens", [None, default_tokens()])
def test_sizes_match_single_runs(spark, tokens):
    values = random_texts(40, seed=9) + ["", None, "1 2\n3 4"]
    together = ch.chunk_sizes(texts(spark, values), [1, 3], tokens=tokens)
    found = {}
    for r in together.collect():
        found.setdefault(r["split_length"], []).append((r["id"], r["split_id"], r["tokens"]))
    for n in (1, 3):
        single = ch.chunk(texts(spark, values), split_length=n, max_tokens=None).select("id", "split_id", "tokens")
        assert sorted(found[n]) == sorted(tuple(r) for r in single.collect())


def test_split_by_is_checked(spark):
    with pytest.raises(ValueError):
        ch.chunk(texts(spark, ["a"]), split_by="page")


def test_chunking_moves_no_rows(spark):
    plan = ch.chunk(texts(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_row_ids_follow_the_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    found = with_row_id(rows, ["k"])
    assert sorted((r["k"], r["id"]) for r in found.collect()) == [(k, k + 1) for k in range(1000)]
    batches = with_batches(rows, ["k"], 50).collect()
    assert sorted((r["k"], r["batch_id"]) for r in batches) == [(k, k // 50) for k in range(1000)]


def test_row_ids_of_nothing(spark):
    assert with_row_id(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_packing_costs_time_in_proportion_to_the_text(spark):
    def seconds(n):
        page = spark.createDataFrame([(" ".join(f"w{i} a b c." for i in range(n)),)], "content string")
        start = time.perf_counter()
        rows = ch.chunk(page, split_by="word", split_length=6, max_tokens=None)
        assert rows.count() == n and rows.where("tokens <> 4").isEmpty()
        return time.perf_counter() - start

    seconds(500)
    assert seconds(64_000) < 30 * max(0.3, seconds(8_000))  # quadratic: 64 times
