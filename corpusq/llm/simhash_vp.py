"""SimHash near-duplicates through a vantage-point tree over fingerprints.

1. Each whole text gets a 64-bit fingerprint (majority of the shingles' hash bits).
2. Equal fingerprints are one entry: copies, however many, cost one row from here on.
3. Entries are partitioned into a few big shards by the top of a vantage-point tree, fitted on a bounded sample: each
   node has a vantage fingerprint and the median Hamming distance to it. Every entry goes to its own shard; where its
   distance is so close to the radius that the triangle inequality allows a partner on the other side, it also visits
   that side. A shard holds what a task can (`SHARD` fingerprints, 8 bytes each), so there are few borders to be near.
4. A shard is packed into one binary value and read by `SLICES` tasks. Each builds the exact vantage-point tree of the shard,
   sends entries and visitors down its share of the branches, and leaves out those that the triangle bounds rule out;
   the visits inside a shard are never rows. Shards that come out larger are cut into blocks, all pairs of blocks compared.
5. A task emits a spanning forest of its links, never all pairs; components are joined from the forests.

The result is exact: the sample only decides how well the work is divided.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
Null ids take part: `component_id` is the smallest id that is not null, null where a component has none.
Repeated rows give repeated result rows. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusq.llm.common import components
from corpusq.session import join_small, materialize

SHINGLE = 3
RADIUS = 3
SHARD = 1 << 20  # fingerprints of a shard, about: 8 MB
BLOCK = 1 << 21  # a shard with more is cut into blocks of this size
SLICES = 12  # tasks that search one shard
SAMPLE_MOST = 65_536  # entries that the division into shards is fitted on
LEAF = 256  # fingerprints compared directly, at the bottom of a shard's tree
_CELLS = 1 << 17  # distances held at once: they stay in the processor's cache


def fingerprint_one(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned: XXH64 with seed 42, a bit is 1 if set in over half the shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, white space is [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())),
            dtype="<u8", count=len(starts),
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints of a column of texts as signed longs."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint_one(t) for t in batch], dtype=np.uint64).view(np.int64))


def build_tree(sample: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays `point`, `radius`, `near`, `far` of a tree over `sample`; a child below zero is leaf `-1 - child`.

    Of a few candidates the vantage point whose distances spread most is taken. A node whose entries are all equally far
    (one tight group) becomes a leaf: its blocks divide the work then.
    """
    nodes: list[list[int]] = []
    leaves = 0
    todo = [(np.sort(sample.astype(np.uint64)), -1, 0)]
    root = 0
    while todo:
        entries, parent, side = todo.pop()
        place = None
        if len(entries) > leaf:
            candidates = entries[:: max(1, len(entries) // 8)][:8]
            distances = [np.bitwise_count(entries ^ c) for c in candidates]
            best = int(np.argmax([d.std() for d in distances]))
            d = distances[best]
            radius = int(np.median(d))
            radius -= int((d <= radius).all())
            if (d <= radius).any() and (d > radius).any():
                place = len(nodes)
                nodes.append([int(candidates[best]), radius, 0, 0])
                todo += [(entries[d <= radius], place, 2), (entries[d > radius], place, 3)]
        if place is None:
            place, leaves = -1 - leaves, leaves + 1
        if parent < 0:
            root = place
        else:
            nodes[parent][side] = place
    columns = list(zip(*nodes)) if nodes else [(), (), (), ()]
    return {
        "root": np.array(root), "point": np.array(columns[0], dtype=np.uint64),
        "radius": np.array(columns[1], dtype=np.int64), "near": np.array(columns[2], dtype=np.int64),
        "far": np.array(columns[3], dtype=np.int64),
    }


def walk(tree: dict[str, np.ndarray], entries: np.ndarray, radius: int = RADIUS):
    """Leaves of each entry: `(entry index, leaf, native)`.

    A native entry goes down to its own leaf. If a partner within `radius` may be outside the ball of a node while the entry is
    inside, the entry also visits the outside; a visitor visits every side that the triangle inequality leaves open. Two
    linked entries part at one node, and there the inner one visits the outer one's side: each link is seen once.
    """
    out = []
    at = np.full(len(entries), int(tree["root"]), dtype=np.int64)
    index, native = np.arange(len(entries)), np.ones(len(entries), dtype=bool)
    while len(at):
        done = at < 0
        if done.any():
            out.append((index[done], -1 - at[done], native[done]))
            at, index, native = at[~done], index[~done], native[~done]
            if not len(at):
                break
        d = np.bitwise_count(entries[index] ^ tree["point"][at]).astype(np.int64)
        r = tree["radius"][at]
        near, far = tree["near"][at], tree["far"][at]
        inside = d <= r
        own = np.where(inside, near, far)
        visits_far = np.where(native, inside, True) & (d + radius > r)  # visitors: any side still open
        visits_near = ~native & (d - radius <= r)
        parts = [
            (own[native], index[native], np.ones(int(native.sum()), dtype=bool)),
            (far[visits_far], index[visits_far], np.zeros(int(visits_far.sum()), dtype=bool)),
            (near[visits_near], index[visits_near], np.zeros(int(visits_near.sum()), dtype=bool)),
        ]
        at, index, native = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.array([], dtype=int),) * 3


class Forest:
    """Union of links between fingerprints, numbered by their place in a sorted array."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.label = nodes, np.arange(len(nodes))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u):
            x, y = label[u], label[v]
            differ = x != y
            if not differ.any():
                return
            u, v, x, y = u[differ], v[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label[:] = label[label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.nonzero(self.label != np.arange(len(self.nodes)))[0]
        return self.nodes[moved], self.nodes[self.label[moved]]


def tree_search(
    held: np.ndarray, guests: np.ndarray | None = None, radius: int = RADIUS, leaf: int = LEAF, slices: int = 1, n: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside `held`; with `guests`, of those between `held` and `guests` instead.

    The vantage-point tree of `held` is built depth first while the entries go down it as in `walk`, and one branch
    at a time is held, so memory stays near that of the arrays. Of `slices` calls each walks the top of the same tree and then
    takes its share of the branches, so that together they find all links.
    """
    held = np.unique(held)
    alone = guests is None
    guests = held[:0] if alone else np.unique(guests)
    nodes = np.unique(np.concatenate([held, guests])) if len(guests) else held
    found = Forest(nodes)
    top = (8 * slices - 1).bit_length() if slices > 1 else 0
    todo, branch = [(held, guests, 0)], 0
    while todo:
        own, near, depth = todo.pop()
        if not len(own) or not (alone or len(near)):
            continue
        split = None
        if len(own) > leaf:
            candidates = own[:: max(1, len(own) // 4)][:4]
            some = own[:: max(1, len(own) // 512)]
            point = candidates[int(np.argmax([np.bitwise_count(some ^ c).std() for c in candidates]))]
            d = np.bitwise_count(own ^ point).astype(np.int16)
            border = int(np.median(d))
            border -= int((d <= border).all())
            split = d <= border
        leads_down = split is not None and split.any() and not split.all()
        if depth == top or not leads_down and depth < top:
            branch += 1
            if branch % slices != n:
                continue
        if leads_down:
            e = np.bitwise_count(near ^ point).astype(np.int16)
            far = near[e + radius > border]
            if alone:  # of two linked entries on different sides the inner one visits the outer side
                far = np.concatenate([far, own[split & (d + radius > border)]])
            todo += [(own[split], near[e - radius <= border], depth + 1), (own[~split], far, depth + 1)]
            continue
        place = np.searchsorted(nodes, own)
        step = max(1, _CELLS // len(own))
        for asked in (own, near) if alone else (near,):
            for at in range(0, len(asked), step):
                part = asked[at : at + step]
                hit = np.flatnonzero((np.bitwise_count(part[:, None] ^ own[None, :]) <= radius).ravel())
                if len(hit):
                    i, j = np.divmod(hit, len(own))
                    found.add(np.searchsorted(nodes, part)[i], place[j])
    return found.links()


def shards(entries: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """`(leaf, fp, native)`: each entry in its own shard, and in those where a partner may be."""
    order = F.xxhash64("fp")
    count = entries.count()
    part = max(1, count // SAMPLE_MOST)
    sample = entries.where(F.pmod(order, F.lit(part)) == 0).orderBy(order).limit(SAMPLE_MOST)
    # so many sample entries stand for the entries of one shard, at every size
    tree = build_tree(
        np.array([r["fp"] for r in sample.collect()], dtype=np.int64).view(np.uint64), max(1, shard // part)
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy().astype(np.int64)
            index, leaf, native = walk(tree, fp.view(np.uint64), radius)
            yield pd.DataFrame({"leaf": leaf, "fp": fp[index], "native": native})

    return entries.select("fp").mapInPandas(place, "leaf long, fp long, native boolean")


def links(
    entries: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK, slices: int = SLICES
) -> DataFrame:
    """Links `(a, b)` between distinct fingerprints `fp` that connect all within `radius` bits of each other.

    `entries` should be a stored table with one row per fingerprint: it is read three times.
    """
    visits = materialize(shards(entries, radius, shard), "visits")
    sizes = visits.groupBy("leaf").agg(
        F.ceil(F.count_if("native") / block).alias("blocks"), F.ceil(F.count_if(~F.col("native")) / block).alias("guests")
    )  # one row per shard
    cut = join_small(visits, sizes, "leaf")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("native"), F.col("blocks")).otherwise(F.col("guests"))).cast("int")
    last = F.col("blocks").cast("int") - 1
    cut = cut.where("blocks > 0").withColumn("own", own)
    # block pairs (i, j): natives meet natives for i <= j, guests (numbered after the natives) meet each native block
    other = F.explode(F.sequence(F.lit(0), last + F.when(F.col("native"), F.col("guests").cast("int")).otherwise(0)))
    pairs = cut.withColumn("other", other).select(
        "leaf", "fp",
        F.when(F.col("native"), F.least("own", "other")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("native"), F.greatest("own", "other")).otherwise(last + 1 + F.col("own")).alias("j"),
        F.when(F.col("native"), F.col("own") <= F.col("other")).otherwise(False).alias("left"),
        F.when(F.col("native"), F.col("own") >= F.col("other")).otherwise(True).alias("right"),
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().astype("<i8")
        left, right = group["left"].to_numpy(), group["right"].to_numpy()
        guests = None if (left & right).any() else fp[right].tobytes()  # a block with itself, or with another one
        return pd.DataFrame([(fp[left].tobytes(), guests)], columns=["held", "guests"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held, guests, n in zip(batch["held"], batch["guests"], batch["slice"]):
                others = None if guests is None else np.frombuffer(guests, "<u8")
                u, v = tree_search(np.frombuffer(held, "<u8"), others, radius, slices=slices, n=n)
                yield pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    packed = pairs.groupBy("leaf", "i", "j").applyInPandas(pack, "held binary, guests binary")
    # one row per block pair, stored: each slice reads it by itself
    rows = materialize(packed.withColumn("block", F.monotonically_increasing_id()), "packed")
    cuts = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return cuts.repartition("block", "slice").drop("block").mapInPandas(search, "a long, b long")


def classes(prints: DataFrame, **options) -> DataFrame:
    """`(fp, component_id)` for a stored table `prints (doc_id, fp)`."""
    entries = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    roots = components(materialize(links(entries, **options), "links"), "near-components")
    joined = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    held = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = held.groupBy("root").agg(F.min("least").alias("component_id"))
    return held.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    prints = materialize(docs.select("doc_id", fingerprint(F.col(text)).alias("fp")), "prints")
    found = prints.join(classes(prints, **options), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the smallest id stays.

    Rows are numbered in a stored copy, so repeated rows and null ids are told apart too.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    marked = row.withColumn("_fp", fingerprint(F.col(f"_row.{text}"))).withColumn("_n", F.monotonically_increasing_id())
    held = materialize(marked, "marked")
    prints = held.select(F.col("_n").alias("doc_id"), F.col("_fp").alias("fp"), F.col("_row.doc_id").alias("_id"))
    groups = prints.join(classes(prints, **options), "fp")  # component_id: a row number that names the group
    first = groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("doc_id").alias("n"))).alias("s"),
        F.count("*").alias("members"),
    ).where("members > 1").select("component_id", F.col("s.n").alias("kept"))
    gone = groups.join(first, "component_id").where("doc_id <> kept").select(F.col("doc_id").alias("_n"))
    return join_small(held, materialize(gone, "gone"), "_n", "left_anti").select("_row.*")
