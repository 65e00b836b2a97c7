"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

A store is a folder with two files for each shard:

* `.ids`: the ids of its documents one after another, each document closed by the end id, as little-endian unsigned
  integers of 16 bits if the vocabulary has at most 65,536 entries, else of 32 bits. Shards hold ascending ranges of doc_id (nulls first).
* `.mph`: a minimal perfect hash over the shard's keys (bit arrays, one for each level; a key's slot is the rank of
  its bit), and for each slot a 32-bit fingerprint of the key, the number of its first document and
  how many documents carry the key; then the offsets of all documents. No key is stored: a key that is not in the shard is told by its
  fingerprint (or finds no bit), so looking up a key reads one slot, then one slice of the ids.

The shards of a store are listed in its manifest (one row each). Files carry a random part in their names and count
only if the task that wrote them is in the manifest, so a task that ran twice does no harm.

Null and empty texts hold the end id only. Null ids are a key of their own, repeated ids share a key and
have one record each. An empty table gives a store without shards. Extra columns are passed over.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.bpe_tree import encoder, tokenizer_json
from corpusq.session import materialize, scratch_path

END_ID = 0
CACHE = 600_000  # words a writing task remembers; it does nothing else that takes memory
ROWS_PER_SHARD = 8_192
MOST_SHARDS = 16_384  # beyond it shards get longer, so that the manifest stays small
_GAMMA = 2  # bits of a level for each key
_MAGIC = b"TOKMPH01"
MANIFEST = "shard int, path string, width int, docs long, ids long, nulls long, first long, last long"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """SplitMix64 of each key."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bits, keys that collide go to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [0, *(int(b.sum()) for b in levels)]
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) + c for b, c in zip(levels, np.cumsum(counts))]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(64, _GAMMA * len(rest))
            place = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            levels.append(taken)
            rest = rest[~taken[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key has no bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for n, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            place = (_mix(keys[todo], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[todo[hit]] = ranks[place[hit]]
            todo = todo[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, firsts: np.ndarray, counts: np.ndarray, offsets: np.ndarray, nulls: int) -> bytes:
    """Index file: distinct keys, number of the first document and of documents of each, offsets of all documents."""
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    order = np.argsort(slot)
    sizes = np.array([nulls, len(offsets) - 1, len(keys), len(table.levels), *map(len, table.levels)], dtype="<i8")
    parts = [np.packbits(b, bitorder="little").tobytes() for b in table.levels]
    parts += [_fingerprints(keys)[order].astype("<u4").tobytes(), firsts[order].astype("<i8").tobytes()]
    parts += [counts[order].astype("<i8").tobytes(), offsets.astype("<i8").tobytes()]
    return _MAGIC + sizes.tobytes() + b"".join(parts)


class Index:
    """An index file, read."""

    def __init__(self, raw: bytes):
        if raw[:8] != _MAGIC:
            raise ValueError("not an index of a token store")
        nulls, docs, keys, n = np.frombuffer(raw, "<i8", 4, 8).tolist()
        sizes = np.frombuffer(raw, "<i8", n, 40).tolist()
        at, levels = 40 + 8 * n, []
        for size in sizes:
            packed = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, bitorder="little")[:size].astype(bool))
            at += len(packed)
        self.nulls, self.hash = nulls, PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", keys, at)
        self.firsts = np.frombuffer(raw, "<i8", keys, at + 4 * keys)
        self.counts = np.frombuffer(raw, "<i8", keys, at + 12 * keys)
        self.offsets = np.frombuffer(raw, "<i8", docs + 1, at + 20 * keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first document and count of documents of each key; count 0 where the key is absent."""
        slot = self.hash.slots(keys)
        firsts, counts = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        some = np.nonzero(slot >= 0)[0]
        some = some[self.prints[slot[some]] == _fingerprints(keys[some])]
        firsts[some], counts[some] = self.firsts[slot[some]], self.counts[slot[some]]
        return firsts, counts


@dataclass(frozen=True)
class Store:
    """A written store: its folder and its stored manifest."""

    folder: str
    manifest: DataFrame


def write_store(
    docs: DataFrame, text: str = "text", folder: str | None = None, path: str | None = None,
    rows_per_shard: int = ROWS_PER_SHARD, end_id: int = END_ID,
) -> Store:
    """Encode every whole text and write the shards to `folder` (any file system Arrow can open; the default is in the
    session's shared folder). Texts are range-partitioned by doc_id once; ids are made where they are written."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    config = tokenizer_json(path)
    rows = docs.count()
    shards = max(1, -(-rows // max(rows_per_shard, -(-rows // MOST_SHARDS))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("_t")]  # the second divides a hot key
    dealt = own.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    keyed = dealt.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "_t")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        while first is not None and not len(first):
            first = next(batches, None)
        if first is None:
            return
        fs, base = _open(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/shard-{shard:05d}-{uuid.uuid4().hex}"
        keys, nulls, sizes = [], 0, []
        tool = encoder(config, CACHE)
        width = 2 if max(len(tool.bytes) - 1, end_id) < 65_536 else 4
        with fs.open_output_stream(f"{name}.ids") as out:
            for batch in _with(first, batches):
                keys.append(batch["doc_id"].to_numpy()[~batch["none"].to_numpy()])
                nulls += int(batch["none"].sum())
                for part in _slices(batch["_t"]):
                    for ids in tool.encode(part):
                        held = np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id))
                        out.write(held.astype(f"<u{width}").tobytes())
                        sizes.append(len(held))
        held = np.concatenate(keys).astype(np.int64)
        distinct, firsts, counts = np.unique(held, return_index=True, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        with fs.open_output_stream(f"{name}.mph") as out:
            out.write(pack_index(distinct, firsts + nulls, counts, offsets, nulls))
        low, high = (int(held.min()), int(held.max())) if len(held) else (0, -1)
        yield pd.DataFrame([(shard, name.rpartition("/")[2], width, len(sizes), int(offsets[-1]), nulls, low, high)],
                           columns=["shard", "path", "width", "docs", "ids", "nulls", "first", "last"])

    return Store(folder, materialize(keyed.mapInPandas(write, MANIFEST), "manifest"))


def lookup(store: Store, keys: DataFrame, records: str, work) -> DataFrame:
    """Read the documents of all `keys` (a `doc_id` column, distinct). `work(doc_id, none, start, ids)` makes the values of a
    row of schema `records` from each document found; `start` counts the ids of all documents before it.

    The manifest (at most `MOST_SHARDS` rows) goes to the tasks, which find each key's shard by bisection. Keys are dealt
    out by shard; a task reads one index, then a slice of the payload for each key.
    """
    rows = sorted(store.manifest.collect(), key=lambda r: r["shard"])
    base = np.concatenate([[0], np.cumsum([r["ids"] for r in rows])]).astype(np.int64)
    names, widths = [r["path"] for r in rows], [r["width"] for r in rows]
    keyed_rows = [n for n, r in enumerate(rows) if r["last"] >= r["first"]]
    first = np.array([rows[n]["first"] for n in keyed_rows], dtype=np.int64)
    last = np.array([rows[n]["last"] for n in keyed_rows], dtype=np.int64)
    with_nulls = [n for n, r in enumerate(rows) if r["nulls"]]
    folder = store.folder

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, none = batch["doc_id"].to_numpy().astype(np.int64), batch["none"].to_numpy().astype(bool)
            low, high = np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")
            spread = [with_nulls if n else keyed_rows[a:b] for n, a, b in zip(none, low, high)]
            n = np.fromiter(map(len, spread), dtype=np.int64, count=len(spread))
            yield pd.DataFrame({
                "doc_id": np.repeat(key, n), "none": np.repeat(none, n),
                "at": np.array([s for part in spread for s in part], dtype=np.int32),
            })

    def read(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["at"].iloc[0])
        width = widths[at]
        fs, root = _open(folder)
        with fs.open_input_file(f"{root}/{names[at]}.mph") as f:
            index = Index(f.read())
        key, none = group["doc_id"].to_numpy().astype(np.int64), group["none"].to_numpy().astype(bool)
        firsts, counts = index.find(key)
        firsts, counts = np.where(none, 0, firsts), np.where(none, index.nulls, counts)
        out = []
        with fs.open_input_file(f"{root}/{names[at]}.ids") as payload:
            for i in np.nonzero(counts)[0]:
                for n in range(firsts[i], firsts[i] + counts[i]):
                    a, b = int(index.offsets[n]), int(index.offsets[n + 1])
                    raw = payload.read_at(width * (b - a), width * a)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    out.append(work(int(key[i]), bool(none[i]), int(base[at]) + a, ids))
        return pd.DataFrame(out, columns=fields)

    fields = [f.split()[0] for f in records.split(", ")]
    keyed = keys.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"))
    return keyed.mapInPandas(route, "doc_id long, none boolean, at int").groupBy("at").applyInPandas(read, records)


def digest(key: int, none: bool, start: int, ids: np.ndarray) -> tuple:
    """Place, length and checksum (over unsigned 32-bit integers) of a document's ids. The key is text, for whole numbers
    beside nulls would become floats."""
    return None if none else str(key), start, len(ids), zlib.crc32(ids.tobytes())


def read_digests(store: Store, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (with the end id), ids_crc32 of every document, read back by key."""
    found = lookup(store, keys, "doc_id string, start long, n_tokens long, ids_crc32 long", digest)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest_totals(store: Store) -> DataFrame:
    return store.manifest.agg(F.count("*").alias("shards"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))


def _open(folder: str):
    """Arrow's file system for a folder, and the folder's path there."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(folder)
    found.create_dir(path, recursive=True)
    return found, path


def _with(first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield from rest


def _slices(texts: pd.Series, characters: int = 2_000_000) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokens(spark: SparkSession, store: Store, doc_ids: list[int]) -> list[tuple[int, list[int]]]:
    """The ids of a few documents, for use from the driver."""
    keys = spark.createDataFrame([(i,) for i in dict.fromkeys(doc_ids)], "doc_id long")
    found = lookup(store, keys, "doc_id long, ids array<long>", lambda key, none, start, ids: (key, ids.tolist()))
    return [(r["doc_id"], r["ids"]) for r in found.collect()]
