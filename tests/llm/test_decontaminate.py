import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from corpusq.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def replaced(size):
    return 2 if size >= 11 else 1 if size >= 5 else 0


def brute(docs, items):
    """All diagonals of all pairs, without seeds or masks."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, question in items:
            q = words(question)
            wide = min(13, len(q))
            for diagonal in range(-len(q), len(w)):
                same = [0 <= diagonal + j < len(w) and w[diagonal + j] == x for j, x in enumerate(q)]
                if not any(same):
                    continue
                longest = max(sum(same[i : i + wide]) for i in range(len(q) - wide + 1))
                if longest >= wide - replaced(len(q)):
                    out[doc, item] = max(out.get((doc, item), (-1,)), (longest, sum(same), -diagonal, len(q)))
    return sorted((str(k[0]), str(k[1]), b[3], b[1], b[0], -b[2]) for k, b in out.items())


Q = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
SHORT = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(0, Q), (1, SHORT), (2, "too short to seed"), (3, None), (4, ""), (5, Q), (None, "un deux trois quatre cinq six sept huit neuf dix onze")]
SUBSTITUTED = Q.replace("zeta", "OTHER").replace("mu", "else")
DOCS = [
    (0, "start " + Q + " end"), (1, SUBSTITUTED), (2, None), (3, ""), (4, "nothing of the kind " * 5),
    (5, "### ".join(Q.upper().split()) + "!!"), (6, "ninth " + SHORT.replace("five", "5ive") + " tail"), (7, " ".join(Q.split()[:9]) + " x y z"),
    (8, "noise " * 20_000 + Q), (None, SHORT), (0, "again " + Q), (9, (Q + " ") * 30), (10, " ".join(Q.split()[4:18])),
    (11, "un deux trois quatre cinq six sept huit neuf dix onze"), (12, Q.replace("beta", "b").replace("delta", "d").replace("zeta", "z").replace("theta", "t")),
]


def rows(df):
    return sorted((str(r["doc_id"]), str(r["item_id"]), r["item_words"], r["matched"], r["longest"], r["doc_at"]) for r in df.collect())


def test_equals_brute_force(spark, make):
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id int, size string")
    docs = make(DOCS)
    found = rows(d.overlaps(docs, items))
    assert found == brute(DOCS, ITEMS)
    ids = {r[0] for r in found}
    assert {"0", "1", "5", "6", "8", "9", "10", "11", "None"} <= ids and not ids & {"2", "3", "4", "7"}
    left = d.clean(docs, items)
    assert left.columns == docs.columns
    assert {str(r["doc_id"]) for r in left.collect()} == {str(i) for i, _ in DOCS} - ids


def test_empty_tables(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.overlaps(make([]), items).collect() == []
    assert d.overlaps(make(DOCS), none).collect() == []
    assert d.clean(make(DOCS), none).count() == len(DOCS)


def test_masks_leave_a_seed_for_every_substitution():
    for size in range(d.SPAN, d.WINDOW + 1):
        mask = d.MASKS[0 if size >= d.WINDOW else 1]
        for bad in combinations(range(size), d.SUBSTITUTED):
            assert any(not {j + k for k in mask} & set(bad) for j in range(size - mask[-1])), (size, bad)
    for size in range(5, 11):
        for bad in range(size):
            assert any(bad not in mask for mask in d.masks_of(size).values()), (size, bad)


def all_diagonals(docs, items):
    """Ids of the documents that hold an item; no seeds."""
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, question in items:
            q = words(question)
            wide = min(d.WINDOW, len(q))
            least = wide - replaced(len(q))
            for diagonal in range(-len(q), len(w)):
                same = [0 <= diagonal + j < len(w) and w[diagonal + j] == x for j, x in enumerate(q)]
                if q and max(sum(same[i : i + wide]) for i in range(len(q) - wide + 1)) >= least:
                    out.add((str(doc), str(item)))
    return out


def test_every_pair_of_replaced_words(spark, make):
    docs, items = [], []
    for size in (11, 12, 13, 14):
        text = Q.split()[:size] if size != 12 else SHORT.split()
        items.append((size, " ".join(text)))
        for bad in combinations(range(size), 2):
            changed = " ".join("zz" if i in bad else x for i, x in enumerate(text))
            docs += [(len(docs), changed), (len(docs) + 1, "aa " + changed + " bb")]
    pick = random.Random(1)
    docs += [(len(docs) + i, " ".join(pick.choices(Q.split()[:6], k=40))) for i in range(20)]
    docs += [(len(docs), " ".join(Q.split()[2:13])), (len(docs) + 1, " ".join(SHORT.split()[1:11]))]  # cut at the edges
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(str(r["doc_id"]), str(r["item_id"])) for r in d.overlaps(make(docs), frame).collect()}
    assert found == all_diagonals(docs, items) and len(found) > 600


def test_short_items(spark, make):
    items = [(0, "What is it?"), (1, "yes"), (2, "one two three four five six seven eight nine ten"), (3, " ... "), (4, "too short to seed")]
    docs = [(0, "He said: WHAT is-it"), (1, "what was it"), (2, "oh yes."), (3, "yesterday"), (4, " ".join(SHORT.split()[:10])),
            (5, "one two three 4 five six seven eight nine ten"), (6, "too short to seed"), (7, "..."), (8, "short to seed")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(str(r["doc_id"]), str(r["item_id"])) for r in d.overlaps(make(docs), frame).collect()}
    assert found == all_diagonals(docs, items) == {("0", "0"), ("2", "1"), ("4", "2"), ("5", "2"), ("6", "4")}
    assert sorted(r["doc_id"] for r in d.clean(make(docs), frame).collect()) == [1, 3, 7, 8]


def test_a_leak_takes_no_other_row_of_its_id(spark, make):
    docs = [(None, SHORT), (None, "clean one"), (None, None), (3, "clean two"), (3, "x " + Q), (3, "clean two"), (4, "clean")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = d.clean(make(docs), items)
    assert left.columns == make(docs).columns
    kept = [(None, "clean one"), (None, None), (3, "clean two"), (3, "clean two"), (4, "clean")]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(kept, key=str)


def test_every_replaced_word_of_short_items(spark, make):
    text = SHORT.split()
    items = [(size, " ".join(text[:size])) for size in range(3, 11)]
    docs = [(n, f"aa {' '.join('zz' if i == bad else x for i, x in enumerate(text[:size]))} bb") for n, (size, bad) in enumerate((s, b) for s in range(3, 11) for b in range(s))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(str(r["doc_id"]), str(r["item_id"])) for r in d.overlaps(make(docs), frame).collect()}
    assert found == all_diagonals(docs, items)


def test_a_frequent_short_item_has_one_place_for_each_row(spark, make):
    docs = make([(i, "the " * 2_000) for i in range(5)]).selectExpr("doc_id as _n", "text")
    items = spark.createDataFrame([(0, "The")], "item long, text string").withColumn("h", d.word_hashes(F.col("text"))).withColumn("size", F.size("h"))
    hits = d.diagonals(docs.select("_n", d.word_hashes(F.col("text")).alias("h")), items)
    assert sorted((r["_n"], r["diagonal"]) for r in hits.collect()) == [(i, 0) for i in range(5)]
