import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusq.llm import bpe_tree as b
from corpusq.llm import token_store as ts

ALPHABET = ["a", "th", " the", " ", "  ", "\n", "'", "'s", "'ll", "1", "!", "é", "ß", "\t", "漢", "😀", "<|endoftext|>", "\r\n", "\x1c", "\xa0", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(b.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts():
    r = random.Random(3)
    for n in range(250):
        some = r.choice([ALPHABET, r.sample(ALPHABET, 3), ["a", "b", "th", "é"], [" ", "\n", "\xa0", "x"], ["!", "#", "'"]])
        yield "".join(r.choice(some) for _ in range(r.choice([1, 7, 60, 400])))


def test_joined_halves_equal_the_library(library):
    tool = b.Encoder(b.tokenizer_json())
    for text in texts():
        expected = ids_of(library, text)
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == expected
        assert tool.decode(np.array(expected, "<u4").tobytes()) == library.decode(expected, skip_special_tokens=False)
        for count in (2, 4, 8):
            if len(text) >= count:
                cuts = [i * len(text) // count for i in range(count + 1)]
                parts = [(text[i:j], np.array(ids_of(library, text[i:j]), "<u4")) for i, j in zip(cuts, cuts[1:])]
                assert b.concatenate(tool, parts).tolist() == expected


CASES = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "null id"), (4, "word " * 9_000), (5, "a" * 40_000), (6, " x<|endoftext|> y"), (-7, "negative"), (None, ""), (2**53 + 1, "large id")]


def test_digests(make, library):
    found = b.digests(make(CASES), piece=1_000).collect()
    expected = []
    for i, t in CASES:
        ids = ids_of(library, t)
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(expected)
    assert b.digests(make([])).collect() == []


def test_store_round_trip(spark, make, library):
    docs = make(CASES)
    store = ts.write_store(docs, rows_per_shard=3)
    found = sorted(ts.read_digests(store, docs.select("doc_id").distinct()).collect(), key=lambda r: r["start"])
    at, seen = 0, []
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]))
    ids = [r["doc_id"] for r in found]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    expected = [(str(i), np.array([*ids_of(library, t), 0], "<u4")) for i, t in CASES]
    assert sorted(seen) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in expected)
    assert ts.tokens(spark, store, [3, 999]) == [(3, [*ids_of(library, "plain text"), 0])] * 2
    empty = ts.write_store(make([]))
    assert ts.read_digests(empty, make([]).select("doc_id")).collect() == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5_000))
    table = ts.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    index = ts.Index(ts.pack_index(keys, np.arange(len(keys)), np.ones(len(keys), dtype=np.int64), np.arange(len(keys) + 1), 0))
    firsts, counts = index.find(keys)
    assert (firsts == np.arange(len(keys))).all() and (counts == 1).all()
    assert index.find(keys + 1)[1].sum() <= np.isin(keys + 1, keys).sum() + 1
