"""The prefix trie of rebuilt conversations, by whole-sequence collapse.

Every conversation c is rebuilt from the first h turns of conversation c - c mod 5 (h = crc32 of c mod 9) and its own turns
after its first h. A node of depth d is a distinct sequence of first d turns; the root has none.

1. Turns become two 64-bit hashes and a size; texts go no further. A sequence of turns is told by the XOR of its turns' hashes,
   each taken with its place, so a prefix's fingerprint (128 bits) is a running XOR and needs no step for each depth.
2. Identical rebuilt conversations collapse into one weighted sequence with the list of conversations that end there.
3. A sequence that is a proper prefix of another one is dropped by an anti-join: what stays are the leaves.
4. Prefixes of the weighted sequences are aggregated once for members, and the leaves' prefixes once for leaves and bytes.

Bytes below a node, each node once: a node is owned by the smallest leaf below it, and then a leaf owns one run of nodes that ends at the leaf.
All runs below a node lie wholly below it, but for that of its own owner. So two sums over prefixes give
`saved_tokens` without walking the trie.

A conversation may hold a third of all turns: running values are taken inside range partitions first, then carried over by one row for each
partition and conversation. End lists are hashed as a stream of sorted chunks.

Null roles and texts are empty. Turns of equal number are ordered by role, then text; null numbers come first. Turns without conv_id
belong to no conversation. `c mod 5` is never negative. Repeated rows are turns of their own. An empty table has no node. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.session import join_small, materialize

HEADS = 9  # a conversation takes 0 to 8 turns of its first relative
FAMILY = 5
CHUNK = 1_024  # ids of a list that are hashed at once
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row place in the low 33 bits


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, tuple[str, str]], keep: list[str], name: str) -> DataFrame:
    """Add running values in `order` inside each `key`: `values` maps a new column to (`sum` or `bit_xor`, column).

    Rows are range-partitioned and sorted once and written with their place, so a key of any size is spread over
    many partitions. Values run inside (key, partition); what earlier partitions of a key hold is added from one row for each.
    """
    placed = materialize(
        df.orderBy(key, *order).select(key, *keep, F.monotonically_increasing_id().alias("_place")), name
    ).withColumn("_part", F.shiftrightunsigned("_place", _LOCAL_BITS))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    call = {"sum": F.sum, "bit_xor": F.bit_xor}
    pieces = placed.groupBy(key, "_part").agg(*[call[f](c).alias(f"_{n}") for n, (f, c) in values.items()])
    first = next(iter(values))
    carried = pieces.select(key, "_part", *[call[f](f"_{n}").over(before).alias(f"_{n}") for n, (f, _) in values.items()])
    carried = carried.where(F.col(f"_{first}").isNotNull())  # only keys that go on from the partition before: one each
    own = placed.select("*", *[call[f](c).over(inside).alias(n) for n, (f, c) in values.items()])
    both = join_small(own, carried, [key, "_part"], "left")

    def total(n: str, f: str) -> Column:
        part = F.coalesce(F.col(f"_{n}"), F.lit(0))
        return (F.col(n).bitwiseXOR(part) if f == "bit_xor" else F.col(n) + part).alias(n)

    return both.select(key, *keep, *[total(n, f) for n, (f, _) in values.items()])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(conv_id, depth, t1, t2, bytes)` of all turns of rebuilt conversations, and all `conv_id`s."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
    ).select(
        "*", F.xxhash64(F.lit("a"), "role", "text").alias("t1"), F.xxhash64(F.lit("b"), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    keep = ["t1", "t2", "bytes", "one"]
    numbered = materialize(running(turns, "conv_id", order, {"at": ("sum", "one")}, keep, "turns"), "numbered")
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    asked = sizes.select("conv_id", first.alias("first"), heads(F.col("conv_id")).alias("h"))
    opening = sizes.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    known = materialize(asked.join(opening, "first", "left").na.fill({"there": 0}), "families")  # at most five to a key
    lent = numbered.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("at") < HEADS))
    heads_rows = lent.withColumnRenamed("conv_id", "first").join(known, "first").where("at <= h").select(
        "conv_id", F.col("at").alias("depth"), "t1", "t2", "bytes"
    )
    tails = numbered.join(known.select("conv_id", "h", "there"), "conv_id").where("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.least("h", "there")).alias("depth"), "t1", "t2", "bytes"
    )
    return heads_rows.union(tails), known.select("conv_id")


def end_lists(ended: DataFrame, key: list[str]) -> DataFrame:
    """`(key.., ends_sha256)` for rows `(key.., conv_id)`: ids in ascending order, streamed through the digest in chunks."""
    fields = ", ".join(f"{k} long" for k in key)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                same = (batch[key] != batch[key].shift()).any(axis=1).cumsum()
                piece = same * len(batch) + batch.groupby(same).cumcount() // CHUNK
                grouped = batch.groupby(piece.to_numpy(), sort=False)
                out = grouped[[*key, "conv_id"]].first()
                out["ids"] = grouped["conv_id"].agg(lambda ids: ",".join(map(str, ids)))
                yield out

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for batch in batches:
            rows = []
            for *now, ids in zip(*(batch[k] for k in key), batch["ids"]):
                if now == held:
                    state.update(("," + ids).encode())
                    continue
                if held is not None:
                    rows.append((*held, state.hexdigest()))
                held, state = now, hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=[*key, "ends_sha256"])
        if held is not None:
            yield pd.DataFrame([(*held, state.hexdigest())], columns=[*key, "ends_sha256"])

    dealt = ended.select(*key, "conv_id").orderBy(*key, "conv_id")
    cut = dealt.mapInPandas(chunks, f"{fields}, conv_id long, ids string")
    return cut.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInPandas(digests, f"{fields}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = ["depth", "f1", "f2"]
    turns, convs = rebuilt(conversations)
    turns = materialize(
        turns.select("conv_id", "depth", F.xxhash64("depth", "t1").alias("h1"), F.xxhash64("depth", "t2").alias("h2"), "bytes"), "rebuilt"
    )
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"), F.sum("bytes").alias("total")
    )
    ended = materialize(convs.join(whole, "conv_id", "left").na.fill(0), "ended")
    sequences = materialize(
        ended.groupBy(*key).agg(F.count("*").alias("weight"), F.min("conv_id").alias("least"), F.min("total").alias("total")), "sequences"
    )
    # prefixes of each weighted sequence, taken from its smallest conversation
    chosen = sequences.select(F.col("least").alias("conv_id"), "weight", "total", F.col("depth").alias("length"))
    paths = running(
        turns.join(chosen.select("conv_id"), "conv_id"), "conv_id", [F.col("depth")],
        {"f1": ("bit_xor", "h1"), "f2": ("bit_xor", "h2"), "path": ("sum", "bytes")}, ["depth", "h1", "h2", "bytes"], "paths",
    )
    none = F.lit(0).cast("long")
    zero = chosen.select("conv_id", *[none.alias(c) for c in ("depth", "f1", "f2", "bytes", "path")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    prefixes = paths.select(
        "conv_id", *key, "bytes", "path", F.col("f1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("f2").bitwiseXOR(F.col("h2")).alias("p2")
    ).union(zero.select("conv_id", *key, "bytes", "path", "p1", "p2"))
    prefixes = materialize(prefixes.join(chosen, "conv_id"), "prefixes")
    inner = prefixes.where("depth < length").select(*key).distinct()
    leaves = materialize(sequences.join(inner, key, "left_anti").select(F.col("least").alias("conv_id")), "leaves")
    below = materialize(prefixes.join(leaves, "conv_id"), "below")
    owned = below.groupBy(*key).agg(F.count("*").alias("n_leaves"), F.min(F.struct("conv_id", "total")).alias("owner"))
    nodes = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("path").alias("path"),
        F.sum(F.col("weight") * F.col("total")).alias("weighted"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    above = F.col("path") - F.col("bytes")  # bytes of the nodes above
    nodes = materialize(
        nodes.join(owned, key).select(
            *key, "conv_id", "n_convs", "n_leaves", "p1", "p2", F.col("owner.conv_id").alias("owner"),
            (F.col("weighted") - F.col("n_convs") * above).alias("every"), (F.col("owner.total") - above).alias("rest"),
        ), "nodes",
    )
    runs = materialize(nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.max("rest").alias("run")), "runs")
    once = below.join(runs, "conv_id").groupBy(*key).agg(F.sum("run").alias("runs"))
    up = [F.col("depth").alias("_d"), F.col("f1").alias("p1"), F.col("f2").alias("p2")]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children")
    )
    parents = nodes.select(*up, F.col("conv_id").alias("parent_conv_id"))
    found = (
        nodes.join(once, key).join(runs.select(F.col("conv_id").alias("owner"), F.col("run").alias("own_run")), "owner")
        .join(children, key, "left").join(end_lists(ended, key), key, "left")
        .withColumn("_d", F.col("depth") - 1).join(parents, ["_d", "p1", "p2"], "left")
    )
    distinct_bytes = F.col("runs") - F.col("own_run") + F.col("rest")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
        (F.col("every") - distinct_bytes).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
