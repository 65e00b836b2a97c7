"""Cross-tokenizer alignment of whole texts, with corpus-wide counts of id pairs by external spill counting.

Two tokenizers cut the same bytes: A (byte-level BPE) encodes a space and the text, B (sentencepiece) the text, to which it adds that
space itself. Where tokens of both end, the bytes are cut into groups; every A token of a group is linked with every B
token of it. The count of an id pair is the number of documents that hold it linked.

1. Each task encodes its documents. A text is cut at places where both tokenizers split whatever stands around, and each different
   part is encoded once and remembered. Records (pair, document, links) gather until a run is full, are
   radix-partitioned by the A id, sorted side-major (by A id, then B id) and spilled as zstd runs to the shared folder.
2. The directories of the runs (pairs and how many documents of the run hold them) are merged by a k-way heap merge, `FAN_IN`
   runs at a time, until each radix part has one sorted list of pairs with their counts. All pairs of an A id lie side
   by side there, which yields its highest count in the same pass.
3. Each run streams its records past the counts of its part and sends one array back for its documents: how many links have the highest count of
   their A id, and the sum of counts. Arrays of the parts are added for each run.

A pair that all documents hold is one directory entry in each run: nothing is gathered by pair, so no pair is a hot key. Memory
is bounded by the size of a run and of the vocabulary's pairs in one part, not by the corpus.

Null and empty texts, and texts whose joined token bytes differ from space and text (those that hold U+2581), have no tokens:
zeros and an empty digest. Every row is a document of its own, repeated rows and null ids too; ids of any type come back as they are. Strings of special tokens are plain
text. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.bpe_tree import tokenizer_json
from corpusq.session import materialize

RUN_RECORDS = 1 << 21  # records of a run
RUN_DOCS = 65_535  # and its documents: their numbers take 16 bits
PARTS = 64  # radix parts
FAN_IN = 64  # runs merged at once
GROUP = 128  # runs that share one copy of a part's counts when contributions are sent back
CACHE = 400_000  # parts of texts whose tokens a worker remembers
_CACHED_LENGTH = 64
_TOGETHER = 2_000  # parts encoded in one call
_LARGE = 1 << 20  # links of a group that are not laid out one by one
_DOC_BITS = 40  # of a pair; the number of the text in its batch stands above
_BLOCK = 8_192  # pairs of a run that the merge holds at once
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_ODD = re.compile(r"[^\S \n][ \n]")  # other white space before a space: no place to cut
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")

_SPILLED = (
    "run long, part int, at int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, docs binary, records binary"
)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_model(path: str | None = None) -> bytes:
    """The model file of B, read on the driver once (0.5 MB) and sent along with the tasks."""
    with open(path or piece_path(), "rb") as f:
        return f.read()


_TOOLS: dict[tuple[int, int, int], Aligner] = {}


def aligner(config: str, model: bytes, cache: int = CACHE) -> Aligner:
    """One aligner for each worker process."""
    key = (hash(config), hash(model), cache)
    if key not in _TOOLS:
        _TOOLS[key] = Aligner(config, model, cache)
    return _TOOLS[key]


class Aligned:
    """What a text gives: numbers of tokens, groups and links, the digest of the groups, distinct pairs and links of each."""

    __slots__ = ("digest", "links", "n_a", "n_b", "n_groups", "n_links", "pairs")

    def __init__(self, n_a: int, n_b: int, n_groups: int, n_links: int, digest: str, pairs: np.ndarray, links: np.ndarray):
        self.n_a, self.n_b, self.n_groups, self.n_links = n_a, n_b, n_groups, n_links
        self.digest, self.pairs, self.links = digest, pairs, links


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the tokens of parts met so far."""

    def __init__(self, config: str, model: bytes, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(config)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(byte_of[c] for c in n) for n in names]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := _BYTE.match(p)) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # places to cut: no piece goes from a visible character to a space or holds a line break
        self.cuts = not any(re.search(r"[^▁]▁|\n", p) for p in pieces)
        self.space = [self.b.piece_to_id("▁")]
        # how a token is shown inside its side of a group and at the side's end
        ends = (("", len(names)), ("", len(names)), ("", self.width), ("", self.width))
        marks = (",", "|", ",", ";")
        self.shown = [f"{i}{mark}" for (_, n), mark in zip(ends, marks) for i in range(n)]
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.room = cache

    def units(self, text: str) -> list[str]:
        """Parts between places where both tokenizers split: a visible character before a space or line break."""
        return [text] if not self.cuts or _ODD.search(text) else _UNIT.findall(text)

    def _tokens(self, parts: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes]]]:
        """New parts with their ids of both sides. Parts that start with a space and end visibly are encoded together: both
        tokenizers split between them, and byte lengths tell which tokens are whose."""
        joined = [p for p in parts if p[0] == " " and not p[-1].isspace() and "▁" not in p] if self.cuts else []
        for at in range(0, len(joined), _TOGETHER):
            some = joined[at : at + _TOGETHER]
            text = "".join(some)
            edges = np.cumsum(np.fromiter((len(p.encode()) for p in some), dtype=np.int64, count=len(some)))
            sides = []
            ids_of = (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1))
            for ids, length in zip(ids_of, (self.a_length, self.b_length)):
                held = np.array(ids, dtype="<u4")
                places = (4 * np.searchsorted(np.cumsum(length[held]), edges, "right")).tolist()
                raw = held.tobytes()
                sides.append([raw[a:b] for a, b in zip([0, *places], places)])
            yield from zip(some, zip(*sides))
        together = set(joined)
        alone = [p for p in parts if p not in together]
        a = [e.ids for e in self.a.encode_batch_fast(alone, add_special_tokens=False)]
        # B adds a space: it stands for the part's own first space, or is the first token before a line break. To an empty
        # text it adds none, so the one space at the end of a text is that token by itself
        b = self.b.encode([p[1:] if p[0] == " " else p for p in alone], num_threads=1)
        for p, x, y in zip(alone, a, b):
            own = self.space if p == " " else y if p[0] == " " else y[1:]
            yield p, (array("I", x).tobytes(), array("I", own).tobytes())

    def documents(self, texts: list[str | None]) -> list[Aligned | None]:
        """What each whole text gives; None for texts without tokens."""
        cut = [self.units(f" {t}") if t else [] for t in texts]
        new = list({u for units in cut for u in units}.difference(self.cache))
        found = dict(self._tokens(new))
        cache = self.cache
        room = self.room - len(cache)
        keep = [u for u in new if len(u) <= _CACHED_LENGTH][: max(0, room)]
        held = found | cache if len(cache) < len(found) else None
        get = held.__getitem__ if held is not None else lambda u: cache[u] if u in cache else found[u]
        sides, kept = [], []
        for n, (text, units) in enumerate(zip(texts, cut)):
            if not units:
                continue
            parts = [get(u) for u in units]
            a, b = (np.frombuffer(b"".join([p[k] for p in parts]), dtype="<u4") for k in range(2))
            raw = f" {text}".encode()
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
                sides.append((a, b))
                kept.append(n)
        cache.update((u, found[u]) for u in keep)
        out: list[Aligned | None] = [None] * len(texts)
        if kept:
            for n, aligned in zip(kept, self.align(sides)):
                out[n] = aligned
        return out

    def align(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[Aligned]:
        """Groups and links of texts given as ids of both sides. Texts are laid end to end: a text's end is an end of both."""
        a, b = (np.concatenate([s[k] for s in sides]).astype(np.int64) for k in range(2))
        n_a, n_b = (np.array([len(s[k]) for s in sides], dtype=np.int64) for k in range(2))
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first_b = last_b + 1 - size_b
        doc = np.searchsorted(np.cumsum(n_a) - 1, last_a)  # the text of each group
        groups = np.bincount(doc, minlength=len(sides))
        n_links = np.zeros(len(sides), dtype=np.int64)
        np.add.at(n_links, doc, size_a * size_b)
        # the groups as text: tokens of both sides in the order of groups, each with the mark that follows it
        of_a, of_b = np.repeat(np.arange(len(common)), size_a), np.repeat(np.arange(len(common)), size_b)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        index_a, index_b = np.arange(len(a)), np.arange(len(b))
        codes[index_a + first_b[of_a]] = a + len(self.a_bytes) * (index_a == last_a[of_a])
        codes[index_b + last_a[of_b] + 1] = b + 2 * len(self.a_bytes) + self.width * (index_b == last_b[of_b])
        shown, ends = list(map(self.shown.__getitem__, codes.tolist())), np.cumsum(n_a + n_b).tolist()
        digests = [hashlib.sha256("".join(shown[x:y])[:-1].encode()).hexdigest() for x, y in zip([0, *ends], ends)]
        # links: each A token with every B token of its group; very large groups by how often each id is in them
        large = size_a * size_b > _LARGE
        some = ~large[of_a]
        times = size_b[of_a][some]
        start = np.cumsum(times) - times
        place = np.arange(int(times.sum())) - np.repeat(start, times) + np.repeat(first_b[of_a][some], times)
        keys = [(np.repeat(doc[of_a][some], times) << _DOC_BITS) | (np.repeat(a[some], times) * self.width + b[place])]
        weights = [np.ones(len(keys[0]), dtype=np.int64)]
        for g in np.flatnonzero(large):
            x, n = np.unique(a[last_a[g] + 1 - size_a[g] : last_a[g] + 1], return_counts=True)
            y, m = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
            keys.append((int(doc[g]) << _DOC_BITS) | (x[:, None] * self.width + y[None, :]).ravel())
            weights.append((n[:, None] * m[None, :]).ravel())
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        if len(keys) == 1:
            links = np.bincount(place, minlength=len(distinct))
        else:
            links = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(links, place, np.concatenate(weights))
        edges = np.searchsorted(distinct, np.arange(len(sides) + 1) << _DOC_BITS).tolist()
        pairs = (distinct & ((1 << _DOC_BITS) - 1)).astype(np.uint64)
        return [
            Aligned(int(n_a[n]), int(n_b[n]), int(groups[n]), int(n_links[n]), digests[n], pairs[x:y], links[x:y])
            for n, (x, y) in enumerate(zip(edges, edges[1:]))
        ]


# --- runs -------------------------------------------------------------------


def _packed(values: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), 3)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(raw), dtype=kind)


class Run:
    """Records of one run while they gather."""

    def __init__(self, number: int):
        self.number, self.rows, self.size = number, [], 0
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, doc_id: str | None, found: Aligned | None) -> None:
        found = found or _NOTHING
        values = (found.n_a, found.n_b, found.n_groups, found.n_links, found.digest)
        self.rows.append((self.number, -1, len(self.rows), doc_id, *values, None, None, None))
        self.pairs.append(found.pairs)
        self.links.append(found.links)
        self.size += len(found.pairs)

    def spilled(self, parts: int, width: int) -> Iterator[tuple]:
        """One row for each radix part: its pairs in side-major order, how many documents hold each, and their records."""
        pairs, links = np.concatenate(self.pairs), np.concatenate(self.links)
        docs = np.repeat(np.arange(len(self.pairs), dtype=np.uint16), [len(p) for p in self.pairs])
        part = (pairs // np.uint64(width)) % np.uint64(parts)
        order = np.lexsort((pairs, part))
        pairs, links, docs = pairs[order], links[order], docs[order]
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for n, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                own, counts = np.unique(pairs[a:b], return_counts=True)
                records = _packed(docs[a:b], "<u2"), _packed(links[a:b], "<i8")
                body = len(records[0]).to_bytes(8, "little") + records[0] + records[1]
                yield (self.number, n, None, None, None, None, None, None, None, _packed(own, "<u8"), _packed(counts, "<i8"), body)


_NOTHING = Aligned(0, 0, 0, 0, "", np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))


def _records(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(body[:8], "little")
    return _unpacked(body[8 : 8 + size], "<u2"), _unpacked(body[8 + size :], "<i8")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """K-way heap merge of sorted `(pairs, counts)` lists; counts of equal pairs are added.

    The heap holds the last pair of each run's current block. Everything up to the smallest of them is final, so it is taken from
    all runs and added up, and the run whose block ended moves on.
    """
    at = [0] * len(runs)
    heap = [(int(p[min(_BLOCK, len(p)) - 1]), n) for n, (p, _) in enumerate(runs) if len(p)]
    heapq.heapify(heap)
    pairs, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    while heap:
        limit = np.uint64(heap[0][0])
        taken, sizes = [], []
        for n, (p, c) in enumerate(runs):
            end = at[n] + int(np.searchsorted(p[at[n] : at[n] + _BLOCK], limit, "right"))
            if end > at[n]:
                taken.append(p[at[n] : end])
                sizes.append(c[at[n] : end])
                at[n] = end
        keys, place = np.unique(np.concatenate(taken), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, place, np.concatenate(sizes))
        pairs.append(keys)
        counts.append(total)
        while heap and heap[0][0] <= limit:
            _, n = heapq.heappop(heap)
            own = runs[n][0]
            if at[n] < len(own):
                heapq.heappush(heap, (int(own[min(at[n] + _BLOCK, len(own)) - 1]), n))
    return np.concatenate(pairs), np.concatenate(counts)


# --- the operator -----------------------------------------------------------


def spill(
    docs: DataFrame, text: str = "text", path: str | None = None, other_path: str | None = None,
    run_records: int = RUN_RECORDS, parts: int = PARTS,
) -> DataFrame:
    """Encode, align and spill: rows of documents (`part` -1) and rows of runs, one for each radix part."""
    config, model = tokenizer_json(path), piece_model(other_path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _SPILLED.split(", ")]
        tool = aligner(config, model)
        base = TaskContext.get().partitionId() << 32
        run = Run(base)

        def closed(run: Run) -> Iterator[pd.DataFrame]:
            if run.rows:
                for rows in (run.rows, list(run.spilled(parts, tool.width))):
                    frame = pd.DataFrame(rows, columns=names)
                    for c in names[4:8]:
                        frame[c] = frame[c].astype("Int64")
                    frame["at"] = frame["at"].astype("Int32")
                    yield frame

        for batch in batches:
            for part in _by_size(batch):
                for doc_id, found in zip(part["doc_id"], tool.documents(list(part["_t"]))):
                    run.add(doc_id, found)
                    if run.size >= run_records or len(run.rows) >= RUN_DOCS:
                        yield from closed(run)
                        run = Run(run.number + 1)
        yield from closed(run)

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return materialize(own.mapInPandas(work, _SPILLED), "runs")


def _by_size(batch: pd.DataFrame, characters: int = 500_000) -> Iterator[pd.DataFrame]:
    if len(batch):
        for _, part in batch.groupby(batch["_t"].str.len().to_numpy().cumsum() // characters):
            yield part


def count_pairs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """`(part, pairs, docs)`: for each radix part one sorted list of pairs with the number of documents that hold them."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        pairs, docs = merged([(_unpacked(p, "<u8"), _unpacked(d, "<i8")) for p, d in zip(group["pairs"], group["docs"])])
        return pd.DataFrame([(int(group["part"].iloc[0]), int(group["run"].min()), _packed(pairs, "<u8"), _packed(docs, "<i8"))],
                            columns=["part", "run", "pairs", "docs"])

    held = runs.select("part", "run", "pairs", "docs")
    groups = -(-runs.select("run").distinct().count() // fan_in)
    while True:
        held = held.groupBy("part", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).applyInPandas(
            merge, "part int, run long, pairs binary, docs binary"
        )
        if groups <= 1:
            return held.select("part", "pairs", "docs")
        held = materialize(held, "merged")
        groups = -(-groups // fan_in)


def pair_counts(spilled: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The stored counts of all pairs of `spill`'s result."""
    return materialize(count_pairs(spilled.where("part >= 0"), fan_in), "pairs")


def align(
    docs: DataFrame, text: str = "text", path: str | None = None, other_path: str | None = None,
    run_records: int = RUN_RECORDS, parts: int = PARTS, fan_in: int = FAN_IN, group: int = GROUP,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    width = _pieces(other_path)
    spilled = spill(docs, text, path, other_path, run_records, parts)
    counted = pair_counts(spilled, fan_in)
    runs = spilled.where("part >= 0").select("part", "run", "pairs", "docs", "records")
    copies = max(1, -(-runs.select("run").distinct().count() // group))

    def stream(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            pairs, counts = _unpacked(right["pairs"].iloc[0], "<u8"), _unpacked(right["docs"].iloc[0], "<i8")
            side = pairs // np.uint64(width)
            starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(side))))
            best = counts == highest
            for run, own, held, body in zip(left["run"], left["pairs"], left["docs"], left["records"]):
                place = np.repeat(np.searchsorted(pairs, _unpacked(own, "<u8")), _unpacked(held, "<i8"))
                at, links = _records(body)
                n_best, total = np.zeros(int(at.max()) + 1, dtype=np.int64), np.zeros(int(at.max()) + 1, dtype=np.int64)
                np.add.at(n_best, at, links * best[place])
                np.add.at(total, at, links * counts[place])
                rows.append((run, _packed(n_best, "<i8"), _packed(total, "<i8")))
        return pd.DataFrame(rows, columns=["run", "n_best", "total"])

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((2, len(left)), dtype=np.int64)
        for n, c in enumerate(("n_best", "total")):
            for raw in right[c]:
                values = _unpacked(raw, "<i8")
                sums[n, : len(values)] += values
        at = left["at"].to_numpy().astype(np.int64)
        return left[names].assign(n_best=sums[0][at], count_sum=sums[1][at])[[*names[:5], "n_best", "count_sum", names[5]]]

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    bucket = F.pmod(F.xxhash64("run"), F.lit(copies)).alias("g")
    sent = (
        runs.withColumn("g", bucket).groupBy("part", "g")
        .cogroup(counted.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<long>"))).groupBy("part", "g"))
        .applyInPandas(stream, "run long, n_best binary, total binary")
    )
    rows = spilled.where("part = -1").select("run", "at", *names)
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = rows.groupBy("run").cogroup(sent.groupBy("run")).applyInPandas(give, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _pieces(path: str | None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=piece_model(path)).get_piece_size()
