"""Byte-level BPE encoding of whole texts; long texts by tree concatenation.

Texts up to `PIECE` characters are encoded where they lie. A longer text is cut into halves, and these again, down to
leaves of at most `PIECE` characters. Leaves are rows: they are dealt out and encoded in parallel. Neighbours are then joined
up the tree: around each join a window is encoded anew and grows until both sides agree with it exactly.

When do sides agree? The splitting pattern scans from left to right, looks ahead at most three characters
and never back. So a split of the left side that ends three or more characters before the join is a split of the whole text too;
from such a place the window is scanned over the join, and once one of its splits starts where a split of the right side
starts, everything after is equal as well. Inside one unsplit run that crosses the join, merges are local: a sequence of
tokens is the encoding of a run if each adjacent pair is the encoding of its own bytes. There the window
goes from token to token and agrees if its first and last tokens equal those of the sides.

Null and empty texts have no tokens. Repeated rows are encoded each. An empty table gives an empty result. Ids of any
type, null or not, come back as they are: they pass through the tasks as text, never as a float.
Extra columns are passed over. The special token's string is split off wherever it stands, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.session import materialize

PIECE = 32_768  # characters of a leaf
CACHE = 300_000  # different words a worker remembers
LOOK_AHEAD = 3
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n]")
_RUN = re.compile(r"\s[ \n]")
_ODD = re.compile(r"[^\S \n][ \n]")  # other white space before a space: no place to cut


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file as text, read on the driver once (1.5 MB) and sent along with the tasks."""
    with open(path or default_path(), encoding="utf-8") as f:
        held = json.load(f)
    held["truncation"] = held["padding"] = None
    return json.dumps(held, ensure_ascii=False)


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(config: str, cache: int = CACHE) -> Encoder:
    """One encoder for each worker process."""
    key = (hash(config), cache)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(config, cache)
    return _ENCODERS[key]


class Encoder:
    """The library's tokenizer with a cache of words, and the table of token bytes."""

    def __init__(self, config: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(config)
        self.special = {t["content"]: t["id"] for t in json.loads(config)["added_tokens"]}
        size = self.library.get_vocab_size(with_added_tokens=True)
        # byte-level vocabularies write each byte as one printable character
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [n.encode() if n in self.special else bytes(byte_of[c] for c in n) for n in names]
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.room = cache

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from the library, as little-endian unsigned 32-bit integers."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def units(self, text: str) -> list[str]:
        """Parts of a text between places where it is split whatever stands around them: a character that is no
        white space before a space or line break."""
        if "\0" not in text and not _RUN.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return [text] if _ODD.search(text) else _UNIT.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text; each different part is encoded once and remembered while there is room."""
        cut = [self.units(t) for t in texts]
        new = set()
        for units in cut:
            new.update(units)
        cache = self.cache
        new = list(new.difference(cache))
        full = len(cache) + len(new) > self.room
        cache.update(self._remember(new))
        out = [b"".join(map(cache.__getitem__, units)) for units in cut]
        if full:
            for u in new:
                del cache[u]
        return out

    def _remember(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """New parts with their ids. Those that start with a space or line break and end visibly are encoded as one
        text, which splits between them, and told apart by their bytes."""
        alone = [p for p in parts if p[:1] not in (" ", "\n") or p[-1].isspace()]
        yield from zip(alone, self.plain(alone))
        rest = [p for p in parts if p[:1] in (" ", "\n") and not p[-1].isspace()]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            raw = self.plain(["".join(some)])[0]
            ends = np.cumsum(self.length[np.frombuffer(raw, dtype="<u4")])
            sizes = np.fromiter((len(p.encode()) for p in some), dtype=np.int64, count=len(some))
            places = (4 * np.searchsorted(ends, np.cumsum(sizes), side="right")).tolist()
            yield from zip(some, (raw[a:b] for a, b in zip([0, *places], places)))

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids, skip_special_tokens=False): the tokens' bytes, bad sequences replaced."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")

    def splits(self, text: str) -> list[int]:
        """Starts (in characters) of the pieces that the pattern makes, special tokens apart."""
        starts, at = [], 0
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                starts.append(at)
            elif part:
                starts += [at + a for _, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            at += len(part)
        return starts

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of `left + right` from the ids of both, by a growing window around the join."""
        if not left or not right:
            return np.concatenate([left_ids, right_ids])
        width = 64
        reach = max([LOOK_AHEAD, *(len(s) for s in self.special)])
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            start = 0 if a == 0 else self._safe_start(left, a, reach)
            if start is not None:
                window = left[start:] + right[:b]
                join = len(left) - start
                starts = self.splits(window)
                end = self._same_start(starts, right, join, b, reach)
                if end is not None:
                    return self._glue(left[:start], left_ids, window, window[: join + end], right[:end], right_ids)
                holding = max(s for s in starts if s <= join)
                special = any(window.startswith(s, holding) for s in self.special)
                if holding < join and holding == starts[-1] and not special:  # one run, up to the end of the window
                    found = self._join_run(left, left_ids, right, right_ids, start + holding, b)
                    if found is not None:
                        return found
                if b == len(right):
                    return self._glue(left[:start], left_ids, window, window, right, right_ids)
            width *= 2

    def _safe_start(self, left: str, a: int, reach: int) -> int | None:
        """The first place in `left[a:]` where every text is split: a space after a visible character."""
        m = _SAFE.search(left, a)
        return m.start() if m and m.start() <= len(left) - reach else None

    def _same_start(self, starts: list[int], right: str, join: int, b: int, reach: int) -> int | None:
        """The first place (in `right`) where both the window and the right side are split for certain."""
        mine = {s - join for s in starts}
        return next((s for s in self.splits(right[:b]) if s in mine and 0 < s <= b - reach), None)

    def _glue(
        self, before: str, left_ids: np.ndarray, window: str, used: str, dropped: str, right_ids: np.ndarray
    ) -> np.ndarray:
        """Left ids of `before`, the window's ids of its first part `used`, right ids after `dropped`."""
        i = self._count(left_ids, len(before.encode()))
        middle = np.frombuffer(self.plain([window])[0], dtype="<u4")
        middle = middle[: self._count(middle, len(used.encode()))]
        return np.concatenate([left_ids[:i], middle, right_ids[self._count(right_ids, len(dropped.encode())) :]])

    def _count(self, ids: np.ndarray, size: int) -> int:
        return int(np.searchsorted(np.cumsum(self.length[ids]), size, side="right")) if size else 0

    def _join_run(
        self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray, run: int, b: int
    ) -> np.ndarray | None:
        """Join inside one unsplit run that starts at `run` in `left` and covers `right[:b]`.

        Tokens are taken back from the join on the left and on the right until the encoding of the bytes between
        starts with the outermost left token and ends with the outermost right token.
        """
        right_ends = np.cumsum(self.length[right_ids])
        size = int(self.length[left_ids].sum())
        first = len(left[:run].encode())
        limit = len(right[: b if b == len(right) else b - LOOK_AHEAD].encode())
        raw_left, raw_right = left.encode(), right.encode()
        outer = self._count(left_ids, first)  # tokens before the run
        k = 4
        while True:
            i, j = max(outer, len(left_ids) - k), k
            if j > len(right_ids) or right_ends[j - 1] > limit:
                return None
            begin, end = size - int(self.length[left_ids[i:]].sum()), int(right_ends[j - 1])
            try:
                text = (raw_left[begin:] + raw_right[:end]).decode()
            except UnicodeDecodeError:  # a token border inside a character
                k += 1
                continue
            ids = np.frombuffer(self.plain([text])[0], dtype="<u4")
            if (i == outer or ids[0] == left_ids[i]) and ids[-1] == right_ids[j - 1]:
                return np.concatenate([left_ids[:i], ids, right_ids[j:]])
            k *= 2


def concatenate(encoder: Encoder, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join neighbours up the tree of halves."""
    if len(parts) == 1:
        return parts[0][1]
    middle = len(parts) // 2
    left, right = parts[:middle], parts[middle:]
    return encoder.join(
        "".join(t for t, _ in left), concatenate(encoder, left), "".join(t for t, _ in right), concatenate(encoder, right)
    )


def encoded(
    docs: DataFrame, text: str = "text", path: str | None = None, piece: int = PIECE,
    fields: str = "ids binary", work: Callable[[Encoder, bytes], tuple] = lambda tool, ids: (ids,), cache: int = CACHE,
) -> DataFrame:
    """`doc_id` and `fields` of every whole text. `work` makes the fields from the document's ids (little-endian unsigned 32-bit
    integers) in the worker that encoded them; without it the ids are returned."""
    config = tokenizer_json(path)
    kind = docs.schema["doc_id"].dataType
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    names = [f.split()[0] for f in fields.split(", ")]

    def row(doc_id, values: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": doc_id, **{n: [v[k] for v in values] for k, n in enumerate(names)}})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(config, cache)
        for batch in batches:
            for part in _by_size(batch):
                yield row(part["doc_id"], [work(tool, ids) for ids in tool.encode(list(part["_t"]))])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(config, cache)
        for batch in batches:
            for part in _by_size(batch):
                yield part.assign(ids=tool.encode(list(part["_t"])))

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        tool, group = encoder(config, cache), group.sort_values("leaf")
        parts = [(t, np.frombuffer(i, dtype="<u4")) for t, i in zip(group["_t"], group["ids"])]
        return row(group["doc_id"].iloc[:1], [work(tool, concatenate(tool, parts).astype("<u4").tobytes())])

    brief = own.where(F.char_length("_t") <= piece).mapInPandas(short, f"doc_id string, {fields}")
    numbered = own.where(F.char_length("_t") > piece).withColumn("_row", F.monotonically_increasing_id())
    cut = numbered.select("doc_id", "_row", F.posexplode(_leaf_spans(F.char_length("_t"), piece)).alias("leaf", "s"), "_t")
    cut = cut.select("doc_id", "_row", "leaf", F.substring("_t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("_t"))
    # the cut is written once: row numbers stay what they are when a task is lost, and leaves are dealt out evenly
    dealt = materialize(cut, "leaves").repartition("_row", "leaf")
    done = dealt.mapInPandas(leaves, "doc_id string, _row long, leaf int, _t string, ids binary")
    every = brief.union(done.groupBy("_row").applyInPandas(tree, f"doc_id string, {fields}"))
    return every.withColumn("doc_id", F.col("doc_id").cast(kind))


def _leaf_spans(n: Column, piece: int) -> Column:
    """Spans `(a, b)` of a text of `n` characters after halving it (and each half) until they fit."""
    depth = F.greatest(F.lit(0), F.ceil(F.log2(n / piece)))
    count = F.pow(F.lit(2), depth).cast("long")

    def at(i: Column) -> Column:
        return F.floor(i * n / count).cast("int")

    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))


def _by_size(batch: pd.DataFrame, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Slices of a batch that hold a bounded amount of text."""
    if len(batch):
        for _, part in batch.groupby(batch["_t"].str.len().to_numpy().cumsum() // characters):
            yield part


def digest(tool: Encoder, ids: bytes) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids, digest of the decoded text."""
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tool.decode(ids).encode()).hexdigest()


def digests(
    docs: DataFrame, text: str = "text", path: str | None = None, piece: int = PIECE, cache: int = CACHE
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. `cache` is the number of words that a worker remembers."""
    return encoded(docs, text, path, piece, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, cache)
