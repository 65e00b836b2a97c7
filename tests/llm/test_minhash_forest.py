import random
import re

import numpy as np
import pytest

from corpusq.llm import minhash_forest as m

SF = "/root/testdata/sf0.01"


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    where = {}
    for a, s in enumerate(sets):
        for b in sorted({b for x in s for b in where.get(x, ())}):
            common = len(s & sets[b])
            if 100 * common >= percent * (len(s) + len(sets[b]) - common) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
        for x in s:
            where.setdefault(x, []).append(a)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((str(i), len(s), str(least.get(g)), i == least.get(g)) for (i, _), s, g in zip(rows, sets, group))


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def changed(r, words, share):
    return " ".join(f"new{r.random()}" if r.random() < share else w for w in words)


def rows():
    r = random.Random(6)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    out = [(n, changed(r, base, r.choice([0.01, 0.02, 0.03, 0.06]))) for n in range(120)]  # a dense group
    other = [f"v{r.randrange(900)}" for _ in range(60)]
    out += [(1_000 + n, changed(r, other, 0.02)) for n in range(30)]
    out += [(2_000 + n, f"text number {n} of nothing " + " ".join(f"t{n}x{k}" for k in range(20))) for n in range(40)]
    out += [(3_000, None), (3_001, ""), (3_002, " \n\t"), (3_003, "Two words"), (3_004, "two WORDS"), (3_005, "two"), (3_006, "Éa b c"), (3_007, "éa b c")]
    out += [(None, "a null id here"), (None, "a null id here"), (5, "a null id HERE"), (2_000, out[150][1]), (2**53 + 1, "large id alone here"), (None, None)]
    return out + [(4_000, "x y z " * 20_000), (4_001, "x y z " * 19_000), (4_002, " ".join(map(str, range(30_000)))), (4_003, " ".join(map(str, range(31_000))))]


@pytest.mark.parametrize("region", [m.REGION, 12])
def test_equals_brute_force(make, region):
    found = result(m.near_duplicates(make(rows()).repartition(3), region=region))
    expected = brute(rows())
    # ids of rows with a null id are told by their component
    assert found == [(i, n, c, k if i != "None" else c == "None") for i, n, c, k in expected]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(m.near_duplicates(docs)) == brute(rows)


def test_empty_table(make):
    assert m.near_duplicates(make([])).collect() == []


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**64, 2_000, dtype=np.uint64))
    b = np.concatenate([a[:1_700], r.integers(0, 2**64, 300, dtype=np.uint64)])
    true = 1_700 / (len(a) + 300)
    assert abs((m.signature(a) == m.signature(b)).mean() - true) < 0.12
    assert (m.signature(a) == m.signature(a[::-1])).all()
