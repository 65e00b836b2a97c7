"""MinHash near-duplicates through an LSH forest: links of texts whose sets of shingles are alike, confirmed on whole sets.

1. Each whole text gives its set of distinct shingles and 16 x 12 MinHash values. Texts of equal sets are one entry: copies,
   however many, cost one row from here on.
2. The forest: 16 sorted orders of the entries, each by its own 12 values. Neighbours in an order are candidates if they share a
   prefix of at least `FROM` values. A region (entries of one prefix) that holds more than `REGION` entries goes down to
   longer prefixes, two values at a time, until it fits: the depth adapts to how dense the region is, and the neighbours
   with the longest common prefixes stay together.
3. Candidates whose signatures agree far enough are compared on their whole sets, inside the task that holds the region. A pair that shares
   regions in several orders is compared in the first of them only. A region gives a spanning forest of its links, never all pairs.
4. Where regions had to go deeper, entries that lie in different components by now are compared once more at depth `FROM`, in
   pairs of blocks, so that a dense region loses no link.

Two texts of similarity s meet in some order with probability 1 - (1 - s^4)^16: for 0.85 all but 7 of a million links. The signatures of a
linked pair agree in 0.72 of their values but for 3 pairs in 10 million (five standard deviations). No other link can be missed, and none
is reported that the whole sets do not confirm.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles three words (fewer words: the whole sequence is the one shingle). Null
and empty texts and texts of white space have an empty set and are linked with nothing, not even with each other. `component_id` is the smallest
id reachable that is not null, null where there is none; `kept` of a null id is true only then. Repeated rows give repeated
result rows. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import components
from corpusq.session import at_most, join_small, materialize

SHINGLE = 3
PERCENT = 85
TREES, DEPTH = 16, 12
FROM = 4
REGION = 2_048  # entries of a region, which one task compares
MARGIN = 5  # standard deviations by which signatures may differ from the sets they stand for
_WORDS = 1_000_000  # words a worker remembers
_ROWS = 1_024  # shingles hashed at once
_CELLS = 1 << 21  # signature values compared at once
_MULTIPLIERS = np.random.default_rng(85).integers(0, 2**63, (2, TREES * DEPTH), dtype=np.uint64)
_A, _B = _MULTIPLIERS[0] * np.uint64(2) + np.uint64(1), _MULTIPLIERS[1]


class _Words(dict):
    """Hash of each word, made when it is first met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, words: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    import xxhash

    held = (text or "").encode().lower().split()  # bytes: only A-Z change, white space is [\x20\x09-\x0D]
    if not held:
        return np.empty(0, dtype=np.uint64)
    if len(held) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), 2)], dtype=np.uint64)
    values = np.fromiter(map(words.__getitem__, held), dtype=np.uint64, count=len(held))
    mixed = np.zeros(len(held) - size + 1, dtype=np.uint64)
    for n in range(size):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + values[n : len(held) - size + 1 + n])
    return np.unique(mixed)


def signature(held: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each hash function."""
    least = np.full(len(_A), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(held), _ROWS):
        least = np.minimum(least, (held[at : at + _ROWS, None] * _A + _B).min(axis=0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(">u2")


def _key(held: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = np.frombuffer(xxhash.xxh128_digest(held.tobytes()), dtype="<i8")
    return int(raw[0]), int(raw[1])


def _with_sets(docs: DataFrame, text: str, size: int, work, fields: str) -> DataFrame:
    """Rows that `work(doc_id, set)` makes of each document with its set of shingles."""
    names = [f.split()[0] for f in fields.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at : at + 1_000]
                rows = [work(i, shingles(t, words, size)) for i, t in zip(part["doc_id"], part["_t"])]
                yield pd.DataFrame(rows, columns=names)

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return own.mapInPandas(each, fields)


# --- regions ----------------------------------------------------------------


def regions(entries: DataFrame, size: int = REGION) -> tuple[DataFrame, DataFrame]:
    """`(tree, region, e)` of entries that share a region with others, and the same at depth `FROM` where regions went deeper."""
    def prefix(depth: int) -> Column:
        """A region's key: the tree and the first values of the entry's order."""
        return F.xxhash64("tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth))).alias("region")

    every = entries.select("e", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    rows = every.select("e", "tree", prefix(FROM))  # only keys and numbers are moved
    found, wide = [], None
    for depth in range(FROM, DEPTH + 1, 2):
        shared = rows.groupBy("region").agg(F.count("*").alias("held")).where("held > 1")
        here = materialize(rows.join(shared, "region").select("tree", "region", "e", "held"), "regions")
        if wide is None:
            wide = here.where(F.col("held") > size)
        found.append(here.where(F.col("held") <= size).select("tree", "region", "e"))
        large = here.where(F.col("held") > size)
        if at_most(large, 0):
            break
        rows = large.select("e", "tree").join(entries.select("e", "sig"), "e").select("e", "tree", prefix(depth + 2))
    else:  # equal in all values: any division will do
        part = F.pmod(F.xxhash64("e"), F.ceil(F.col("held") / size))
        found.append(large.select("tree", F.xxhash64("region", part).alias("region"), "e"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result, wide


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a sorted stream; a group that a batch cuts is held until its end has come."""
    held: list[pd.DataFrame] = []

    def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
        return all(a[k].iloc[-1] == b[k].iloc[0] for k in keys)

    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, dtype=bool)
        for k in keys:
            change |= batch[k].to_numpy()[1:] != batch[k].to_numpy()[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        if held and not same(held[-1], batch):
            yield pd.concat(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            if held and a:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held)


def _pairs(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates `(i, j, agreement)` of a region: places of two entries not yet joined or compared elsewhere, most alike first.

    `upto` says how many trees come first: entries that share a region in one of them are compared there. Entries of the same
    `side` are not compared where sides are given (not below zero).
    """
    sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint16).reshape(len(group), -1)
    own = np.array(group["regs"].tolist(), dtype=np.int64)[:, : int(group["upto"].iloc[0])]
    n, joined, side = (group[c].to_numpy() for c in ("n", "joined", "side"))
    share = percent / 100
    least = share - MARGIN * np.sqrt(share * (1 - share) / sig.shape[1])
    out = []
    step = max(1, _CELLS // (len(group) * sig.shape[1]))
    for a in range(0, len(group), step):
        i = np.arange(a, min(a + step, len(group)))[:, None]
        j = np.arange(a, len(group))[None, :]
        fits = (i < j) & (joined[i] != joined[j]) & ((side[i] < 0) | (side[i] != side[j]))
        fits &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = np.nonzero(fits)
        i, j = i + a, j + a
        for tree in range(own.shape[1]):
            if not len(i):
                break
            apart = (own[i, tree] != own[j, tree]) | (own[i, tree] == 0)
            i, j = i[apart], j[apart]
        alike = np.concatenate([(sig[i[k : k + 8_192]] == sig[j[k : k + 8_192]]).mean(axis=1) for k in range(0, len(i), 8_192)] or [[]])
        out.append((i[alike >= least], j[alike >= least], alike[alike >= least]))
    i, j, alike = (np.concatenate([o[k] for o in out]) for k in range(3))
    order = np.argsort(-alike, kind="stable")
    return i[order], j[order], alike[order]


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    place = np.searchsorted(large, small)
    common = int((large[np.minimum(place, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(near: DataFrame, rows: DataFrame, docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Links `(a, b)` that whole sets confirm among the candidates of `rows (group, upto, side, e)`."""
    info = near.select("e", "n", "sig", "regs", "joined")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["group"]):
            i, j, _ = _pairs(group, percent)
            if len(i):
                yield group.iloc[np.unique(np.concatenate([i, j]))][["group", "upto", "side", "e"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["group"]):
            i, j, _ = _pairs(group, percent)
            sets = [np.frombuffer(s, dtype="<u8") for s in group["held"]]
            label, links = list(range(len(group))), []

            def root(x: int) -> int:
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for u, v in zip(i.tolist(), j.tolist()):
                x, y = root(u), root(v)
                if x != y and _similar(sets[u], sets[v], percent):
                    label[max(x, y)] = min(x, y)
                    links.append((u, v))
            if links:
                e = group["e"].to_numpy()
                yield pd.DataFrame({"a": e[[u for u, _ in links]], "b": e[[v for _, v in links]]})

    kept = "group long, upto int, side int, e long"
    # a region is sorted together by its key; it has at most REGION entries, or two blocks of them
    dealt = rows.join(info, "e").repartition("group").sortWithinPartitions("group", "e")
    asked = materialize(dealt.mapInPandas(find, kept), "candidates")
    wanted = materialize(near.join(asked.select("e").distinct(), "e").select("e", "k1", "k2", "doc"), "wanted")
    # whole sets are made anew for the candidates' documents only; texts stay where they lie if the ids are few enough
    ids = materialize(wanted.select(F.col("doc").alias("_doc")).distinct(), "candidate-ids")
    some = join_small(docs, ids, docs["doc_id"].cast("string").eqNullSafe(F.col("_doc")), "left_semi")
    sets = _with_sets(some, text, size, lambda i, s: (*_key(s), s.astype("<u8").tobytes()), "k1 long, k2 long, held binary")
    sets = sets.join(wanted.select("e", "k1", "k2"), ["k1", "k2"]).groupBy("e").agg(F.first("held").alias("held"))
    sets = materialize(sets, "sets")
    full = asked.join(info, "e").join(sets, "e").repartition("group").sortWithinPartitions("group", "e")
    return materialize(full.mapInPandas(compare, "a long, b long"), "links")


def links(near: DataFrame, rows: DataFrame, wide: DataFrame, docs: DataFrame, text: str, size: int, percent: int, region: int) -> DataFrame:
    """Links that connect all similar entries: first inside the regions, then between components where regions were wide."""
    first = _confirmed(
        near.withColumn("joined", F.col("e")), rows.select(F.col("region").alias("group"), F.col("tree").alias("upto"), F.lit(-1).alias("side"), "e"),
        docs, text, size, percent,
    )
    if at_most(wide, 0):
        return first
    joined = near.join(components(first).withColumnRenamed("node", "e"), "e", "left").withColumn("joined", F.coalesce("root", "e"))
    joined = materialize(joined.drop("root"), "joined")
    there = wide.join(joined.select("e", "joined"), "e")
    mixed = there.groupBy("region").agg(F.min("joined").alias("low"), F.max("joined").alias("high")).where("low < high").select("region")
    blocks = F.ceil(F.col("held") / region).cast("int")
    own = F.pmod(F.xxhash64("joined", F.floor(F.xxhash64("e") / F.lit(2**40))), blocks).cast("int")
    cut = there.join(mixed, "region").select("region", "e", blocks.alias("blocks"), own.alias("own"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = cut.select(
        F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("group"), F.lit(TREES).alias("upto"),
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "e",
    )
    return first.unionByName(_confirmed(joined, pairs, docs, text, size, percent))


# --- the operator -----------------------------------------------------------


def near_duplicates(
    docs: DataFrame, text: str = "text", size: int = SHINGLE, percent: int = PERCENT, region: int = REGION
) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept."""
    kind = docs.schema["doc_id"].dataType

    def work(doc_id: str | None, held: np.ndarray) -> tuple:
        return doc_id, len(held), *_key(held), signature(held).tobytes() if len(held) else None

    prints = _with_sets(docs, text, size, work, "doc_id string, n long, k1 long, k2 long, sig binary")
    prints = materialize(prints.withColumn("doc_id", F.col("doc_id").cast(kind)), "prints")
    entries = prints.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n").alias("n")
    )
    entries = materialize(entries.withColumn("e", F.monotonically_increasing_id()), "entries")
    rows, wide = regions(entries, region)
    held = [F.coalesce(F.max(F.when(F.col("tree") == t, F.col("region"))), F.lit(0)) for t in range(TREES)]
    regs = rows.groupBy("e").agg(F.array(*held).alias("regs"))
    near = entries.join(regs, "e").withColumn("doc", F.col("least").cast("string"))
    near = materialize(near.drop("least"), "near")
    found = components(links(near, rows, wide, docs, text, size, percent, region), "forest")
    classes = entries.select("e", "k1", "k2", "least").join(found.withColumnRenamed("node", "e"), "e", "left")
    classes = classes.withColumn("root", F.coalesce("root", "e"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("k1", "k2", "component_id")
    every = prints.select("doc_id", "n", "k1", "k2").where("n > 0").join(named, ["k1", "k2"])
    result = every.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        prints.where("n = 0").select("doc_id", "n", F.col("doc_id"))
    )
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
