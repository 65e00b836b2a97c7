import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusq.llm import bpe_tree
from corpusq.llm import token_alignment as ta

BYTES = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTES |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in BYTES.values())}
ALPHABET = ["a", "the", " the", " ", "  ", "\n", "\n\n", "'s", "12", "!", "é", "ß", "\t", "漢", "😀", "<|endoftext|>", "<s>", "<unk>", "\r\n", "\xa0", "\0", "ﬁ", "<0x41>"]


def rows():
    r = random.Random(4)
    out = [(n, "".join(r.choice(ALPHABET) for _ in range(r.choice([1, 3, 30, 200])))) for n in range(120)]
    out += [(200, None), (201, ""), (202, "a ▁ b"), (203, " "), (204, "the same words"), (204, "the same words"), (None, "the same"), (None, None)]
    return out + [(2**53 + 1, "large id"), (205, "word " * 6_000 + "end"), (206, "x" * 5_000), (207, "漢字" * 300), (208, " lead\n"), (209, "\n")]


def brute(rows):
    a = Tokenizer.from_file(bpe_tree.default_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.piece_path())
    docs, held = [], defaultdict(int)
    for _, text in rows:
        if not text:
            docs.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        links = Counter((u, v) for g, h in groups for u in g for v in h)
        for pair in links:
            held[pair] += 1
        docs.append((len(x), len(y), groups, links))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    out = []
    for (doc_id, _), d in zip(rows, docs):
        if d is None:
            out.append((str(doc_id), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            str(doc_id), n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest(),
        ))
    return sorted(out)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("options", [{}, {"run_records": 300, "parts": 5, "fan_in": 2, "group": 3}])
def test_equals_brute_force(make, options):
    found = ta.align(make(rows()).repartition(3), **options)
    assert found.columns == NAMES
    assert sorted((str(r["doc_id"]), *r[1:]) for r in found.collect()) == brute(rows())


def test_empty_table_and_ids_of_other_types(make):
    assert ta.align(make([])).collect() == []
    named = make([(1, "a b"), (2, None)]).selectExpr("concat('x', doc_id) doc_id", "text")
    assert sorted((r["doc_id"], r["n_a"]) for r in ta.align(named).collect()) == [("x1", 2), ("x2", 0)]


@pytest.mark.parametrize("cache,together", [(40, 3), (10_000, 2_000)])
def test_no_cut_changes_the_tokens(monkeypatch, cache, together):
    monkeypatch.setattr(ta, "_TOGETHER", together)
    tool = ta.Aligner(bpe_tree.tokenizer_json(), ta.piece_model(), cache=cache)
    assert tool.cuts
    texts = [t for _, t in rows() if t and "▁" not in t]
    for again in range(2):
        for text, found in zip(texts, tool.documents(texts)):
            ids = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
            whole = tool.align([tuple(np.array(x, dtype="<u4") for x in ids)])[0]
            assert (found.n_a, found.n_b, found.n_groups, found.n_links, found.digest) == (whole.n_a, whole.n_b, whole.n_groups, whole.n_links, whole.digest)
            assert found.pairs.tolist() == whole.pairs.tolist() and found.links.tolist() == whole.links.tolist()
    assert len(tool.cache) <= cache


def test_one_space_at_the_end_of_a_text(make):
    ends = [(1, "the words "), (2, "the "), (3, "é\n "), (4, "the  "), (5, "the words"), (6, "! ")]
    found = sorted((str(r["doc_id"]), *r[1:]) for r in ta.align(make(ends)).collect())
    assert found == brute(ends) and all(r[1] and r[2] for r in found)


def test_large_groups_are_counted_alike(monkeypatch):
    tool = ta.Aligner(bpe_tree.tokenizer_json(), ta.piece_model())
    texts = [t for _, t in rows() if t]
    plain = tool.documents(texts)
    monkeypatch.setattr(ta, "_LARGE", 1)
    for one, two in zip(plain, tool.documents(texts)):
        assert (one is None) == (two is None)
        if one:
            assert one.pairs.tolist() == two.pairs.tolist() and one.links.tolist() == two.links.tolist() and one.digest == two.digest


def test_merge_equals_counting():
    r = np.random.default_rng(3)
    runs = []
    for size in (0, 1, 50_000, 30_000, 9_000):
        pairs = np.unique(r.integers(0, 60_000, size, dtype=np.uint64))
        runs.append((pairs, r.integers(1, 9, len(pairs))))
    expected = Counter()
    for pairs, counts in runs:
        expected.update(dict(zip(pairs.tolist(), counts.tolist())))
    pairs, counts = ta.merged(runs)
    assert (np.diff(pairs.astype(np.int64)) > 0).all() and dict(zip(pairs.tolist(), counts.tolist())) == expected
