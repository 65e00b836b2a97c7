import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusq.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f1 string, total long"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    members, ends, sequences = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        sequence = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        sequences[c] = sequence
        ends[sequence].append(c)
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "f", 3) for r in rows], SCHEMA).repartition(3)
    found = ct.trie(frame)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def rows(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(-12, 60), 10**15, 2**60 + 1]:
        if r.random() < 0.15:
            continue  # families without their first conversation
        for turn in range(r.choice([0, 1, 1, 2, 5, 9, 14])):
            out.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["é hello", "b", "", None, "long text"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    extra = [(3, None, "user", "first"), (3, None, "user", "first"), (3, 0, "b", "x"), (3, 0, "a", "y"), (None, 1, "user", "of no conversation")]
    check(spark, rows(seed) + extra)


def test_hot_conversation_and_copies(spark):
    long = [(5, n, "user", f"turn {n % 7}") for n in range(300)] + [(6, n, "user", f"turn {n % 7}") for n in range(300)]
    copies = [(c, n, "user", t) for c in range(100, 160) for n, t in enumerate(("same", "talk", "each"))]
    check(spark, long + copies)


def test_empty_table(spark):
    check(spark, [])


def test_long_end_lists_are_streamed(spark, monkeypatch):
    ended = spark.range(5_000).selectExpr("cast(id % 2 as bigint) as k", "9000 - id as conv_id")
    expected = {k: hashlib.sha256(",".join(str(i) for i in range(4_001, 9_001) if (9000 - i) % 2 == k).encode()).hexdigest() for k in (0, 1)}
    assert {r["k"]: r["ends_sha256"] for r in ct.end_lists(ended, ["k"]).collect()} == expected


def test_whole_table(spark):
    talk = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    check(spark, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in talk.collect()])
