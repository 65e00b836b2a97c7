import numpy as np

from corpusq.llm import simhash_vp as v
from corpusq.llm.common import components
from tests.llm.test_pipeline import fingerprint


def brute_components(rows):
    prints = [fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, _), p, g in zip(rows, prints, group))


def rows():
    long = " ".join(f"word{i}" for i in range(900))
    out = [(i, f"text number {i} about nothing " + " ".join(f"t{i}{j}" for j in range(20))) for i in range(40)]
    out += [(100, long), (101, long + " more"), (102, "start " + long), (103, long.upper()), (104, None), (105, ""), (106, " \n")]
    return out + [(107, "one"), (108, "ONE"), (None, long), (None, "alone at last here"), (100, long), (200, "x " * 50_000)] + [(300 + i, long) for i in range(50)]


def test_equals_brute_force(make):
    found = v.near_duplicates(make(rows()), shard=8, block=7, slices=2).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == brute_components(rows())
    assert v.near_duplicates(make([])).collect() == []


def test_tree_loses_no_link():
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**64, 60, dtype=np.uint64)
    flips = [np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in r.integers(64, size=(600, 2))]
    entries = np.unique(np.concatenate([centres, [c ^ f for c, f in zip(r.choice(centres, 600), flips)], r.integers(0, 2**64, 800, dtype=np.uint64)]))
    tree = v.build_tree(entries[::2], 4)
    index, leaf, native = v.walk(tree, entries)
    assert np.bincount(index[native]).tolist() == [1] * len(entries)
    home = dict(zip(index[native].tolist(), leaf[native].tolist()))
    visits = set(zip(index.tolist(), leaf.tolist()))
    near = np.argwhere(np.triu(np.bitwise_count(entries[:, None] ^ entries[None, :]) <= 3, 1))
    assert len(near) > 300
    for a, b in near.tolist():
        assert (a, home[b]) in visits or (b, home[a]) in visits


def test_search_finds_what_all_pairs_find():
    r = np.random.default_rng(9)
    centres = r.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(64, size=(3_000, 2), dtype=np.uint64)
    entries = np.unique(np.concatenate([centres, r.choice(centres, 3_000) ^ flips[:, 0] ^ flips[:, 1], r.integers(0, 2**64, 3_000, dtype=np.uint64)]))
    expected = v.Forest(entries)
    expected.add(*np.nonzero(np.bitwise_count(entries[:, None] ^ entries[None, :]) <= 3))
    found = v.Forest(entries)
    halves = v.Forest(entries)
    for n in range(3):
        for forest, sides in ((found, [(entries, None)]), (halves, [(entries[::2], None), (entries[1::2], None), (entries[::2], entries[1::2])])):
            for own, guests in sides:
                a, b = v.tree_search(own, guests, leaf=16, slices=3, n=n)
                assert len(a) < len(entries)  # a forest, not all pairs
                forest.add(np.searchsorted(entries, a), np.searchsorted(entries, b))
    assert (found.label == expected.label).all() and (halves.label == expected.label).all()


def test_rows_per_entry_do_not_grow():
    r = np.random.default_rng(2)
    for count in (200_000, 1_000_000, 4_000_000):
        part = max(1, count // v.SAMPLE_MOST)
        tree = v.build_tree(r.integers(0, 2**64, count // part, dtype=np.uint64), max(1, v.SHARD // part))
        index, _, _ = v.walk(tree, r.integers(0, 2**64, 100_000, dtype=np.uint64))
        assert len(index) <= 3 * 100_000


def test_search_connects_what_is_linked():
    block = np.array([1 << k for k in range(40)] + [0], dtype=np.uint64)
    a, b = v.tree_search(block)
    assert len(a) == len(block) - 1  # a tree, not all pairs
    apart = np.array([0, 2**20 - 1], dtype=np.uint64)
    assert len(v.tree_search(apart)[0]) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1_000, 1_001), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1_001: 1_000}


def test_keep_one(make):
    docs = make(rows())
    kept = v.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(100) == 1 and not {101, 102, 103, 105, 106, 108, 300} & set(ids)
    assert {104, 107, 200, *range(40)} <= set(ids) and ids.count(None) == 1
