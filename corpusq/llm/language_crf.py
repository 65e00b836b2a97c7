"""Language of words and texts by a linear-chain conditional random field.

Each word of a text is labelled with a language. Its features are affixes, character n-grams and, if the word is in the
learned lexicon, the word itself; transitions between neighbouring words are learned too, so that a text may switch languages. Forward-backward
gives each word's marginals over the whole text; a text's language has the largest sum of them.

Training reads a bounded sample of labelled rows (`SAMPLE_TEXTS` whole texts of each language; the number of rows is the only
bound), joins random runs of them to code-switched sequences and maximises their likelihood in `STEPS` steps. Scoring cuts texts into blocks of words: all blocks are multiplied
out at once, then chained, which is exact for texts of any length.

Null texts and texts without a letter are `und` with score 0, and so is everything if no labelled text exists. Null ids are scored
and not trained on. Repeated rows are scored each. An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.session import join_small, materialize

SAMPLE_TEXTS = 300
SLOTS = 1 << 15  # hashed features
SEQUENCE = 120
RUNS = (4, 40)  # words of one language in a training sequence
STEPS = 140  # gradient steps, as many at every size of the sample
BATCH = 60
RATE = 0.3
LEXICON_LEAST = 3
BLOCK = 64
CACHE = 500_000
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_=+/\\"


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Feature slots of a lower-case word."""
    marked = f"^{word}$"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1)]
    if word in lexicon:
        names.append(f"w{word}")
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    """Languages, weights of features, transition and start scores, lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: frozenset[str]


class Tagger:
    """A model at work in a task, with the emissions of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), dtype=np.float32)
        self.a = np.exp(model.transitions - model.transitions.max(initial=0.0)).astype(np.float64)
        self.pi = np.exp(model.start - model.start.max(initial=0.0))
        self.pi /= self.pi.sum()

    def _learn(self, new: list[str]) -> None:
        """Emissions of new words; -1 marks words without a letter."""
        kept, slots = [], []
        for w in new:
            core = w.strip(_EDGES)
            if core.isalpha() or any(c.isalpha() for c in core):
                kept.append(w)
                slots.append(features(core, self.model.lexicon))
            else:
                self.place[w] = -1
        if kept:
            counts = np.fromiter(map(len, slots), dtype=np.int64, count=len(slots))
            flat = np.concatenate([np.array(s, dtype=np.int64) for s in slots])
            scores = np.add.reduceat(self.model.weights[flat], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
            self.place.update(zip(kept, range(len(self.table), len(self.table) + len(kept))))
            rows = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)).astype(np.float32)
            self.table = np.concatenate([self.table, rows])

    def _places(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.place) > CACHE:
            self.place, self.table = {}, self.table[:0]
        new = set()
        for t in texts:
            new.update(t)
        self._learn([w for w in new if w not in self.place])
        get = self.place.__getitem__
        found = [np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts]
        return [p[p >= 0] for p in found]

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words with a letter, one text after another, and the number of them in each text."""
        places = self._places(texts)
        sizes = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        k = len(self.pi)
        blocks = -(-sizes // BLOCK)
        n = int(blocks.sum())
        if not n:
            return np.zeros((0, k)), sizes
        ends = np.cumsum(blocks)
        step = np.arange(n) - np.repeat(ends - blocks, blocks)  # place of a block in its text
        last = step == np.repeat(blocks, blocks) - 1
        length = np.where(last, np.repeat(sizes, blocks) - step * BLOCK, BLOCK)
        used = np.arange(BLOCK)[None, :] < length[:, None]
        e = np.ones((n, BLOCK, k))
        e[used] = self.table[np.concatenate(places)]
        enter = np.where((step == 0)[:, None, None], np.broadcast_to(self.pi, (k, k)), self.a)
        product = enter * e[:, 0, None, :]
        for t in range(1, BLOCK):
            now = (product @ self.a) * e[:, t, None, :]
            now /= now.max(axis=(1, 2), keepdims=True)
            product = np.where(used[:, t, None, None], now, product)
        order = np.argsort(step, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(step))[:-1])
        before, after = np.full((n, k), 1.0 / k), np.ones((n, k))
        for rows in groups[1:]:
            x = np.einsum("nk,nkj->nj", before[rows - 1], product[rows - 1])
            before[rows] = x / x.sum(axis=1, keepdims=True)
        for rows in reversed(groups[1:]):
            x = np.einsum("nkj,nj->nk", product[rows], after[rows])
            after[rows - 1] = x / x.max(axis=1, keepdims=True)
        alpha = np.empty((n, BLOCK, k))
        x = before
        for t in range(BLOCK):
            x = (np.einsum("nk,nkj->nj", x, enter) if t == 0 else x @ self.a) * e[:, t]
            x = x / x.sum(axis=1, keepdims=True)
            alpha[:, t] = x
        beta = after
        for t in range(BLOCK - 1, -1, -1):
            alpha[:, t] *= beta
            back = (beta * e[:, t]) @ self.a.T
            beta = np.where(used[:, t, None], back / back.max(axis=1, keepdims=True), beta)
        gamma = alpha[used]
        return gamma / gamma.sum(axis=1, keepdims=True), sizes

    def texts(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and score (share of the marginals) of each text."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        gamma, sizes = self.marginals(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])
        votes = sums[ends[1:]] - sums[ends[:-1]]
        best = votes.argmax(axis=1)
        return [
            (self.model.languages[b], float(min(1.0, v[b] / s))) if s else (UNKNOWN, 0.0) for b, v, s in zip(best, votes, sizes)
        ]


def train(sample: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Fit on `(language, words)` of a bounded sample, by AdaGrad on code-switched sequences."""
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    clean: dict[int, list[list[str]]] = {n: [] for n in range(k)}
    for lang, words in sample:
        kept = [w for w in (x.strip(_EDGES) for x in words) if any(c.isalpha() for c in w)]
        if kept:
            clean[languages.index(lang)].append(kept)
    clean = {n: texts for n, texts in clean.items() if texts}
    counts = Counter(w for texts in clean.values() for t in texts for w in t)
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_LEAST)
    slots: dict[str, np.ndarray] = {}
    random = np.random.default_rng(seed)
    weights, transitions, start = np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-8) for x in (weights, transitions, start)]
    present = sorted(clean)
    for _ in range(STEPS if clean else 0):
        words, gold = [], np.empty((BATCH, SEQUENCE), dtype=np.int64)
        for b in range(BATCH):
            row: list[str] = []
            while len(row) < SEQUENCE:
                lang = present[random.integers(len(present))]
                text = clean[lang][random.integers(len(clean[lang]))]
                size = int(random.integers(*RUNS))
                at = int(random.integers(max(1, len(text) - size)))
                run = text[at : at + size][: SEQUENCE - len(row)]
                gold[b, len(row) : len(row) + len(run)] = lang
                row += run
            words += row
        slots.update((w, np.array(features(w, lexicon), dtype=np.int64)) for w in set(words).difference(slots))
        own = [slots[w] for w in words]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.concatenate(own)
        score = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0).reshape(BATCH, SEQUENCE, k)
        gamma, pairs = _expectations(score, transitions, start)
        target = np.eye(k)[gold]
        error = (target - gamma).reshape(-1, k) / len(words)
        grads = [np.zeros_like(weights), np.zeros((k, k)), (target[:, 0] - gamma[:, 0]).mean(axis=0)]
        np.add.at(grads[0], flat, np.repeat(error, sizes, axis=0))
        np.add.at(grads[1], (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
        grads[1] = (grads[1] - pairs) / len(words)
        for value, grad, square in zip((weights, transitions, start), grads, squares):
            square += grad**2
            value += RATE * grad / np.sqrt(square)
    return Model(languages, weights, transitions, start, lexicon)


def _expectations(score: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and summed pair marginals of equally long sequences."""
    e = np.exp(score - score.max(axis=2, keepdims=True))
    a, steps = np.exp(transitions - transitions.max()), score.shape[1]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    x = np.exp(start - start.max()) * e[:, 0]
    for t in range(steps):
        x = x if t == 0 else (x @ a) * e[:, t]
        x = x / x.sum(axis=1, keepdims=True)
        alpha[:, t] = x
    for t in range(steps - 2, -1, -1):
        x = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = x / x.max(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((len(start), len(start)))
    for t in range(steps - 1):
        p = alpha[:, t, :, None] * a[None] * (e[:, t + 1] * beta[:, t + 1])[:, None, :]
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, pairs


def part_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS) -> Model:
    """Train on the `texts` rows of each language that are first by a hash of their id.

    Ranks are cut to that number in each task before the shuffle; texts are read for the chosen ids only.
    """
    order = Window.partitionBy(lang).orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    chosen = known.select("doc_id", lang).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= texts)
    chosen = materialize(chosen.select("doc_id").distinct(), "sample")  # `texts` ids for each language
    rows = join_small(known, chosen, "doc_id").select(lang, F.split(F.trim(F.lower(F.col(text))), r"\s+").alias("w"), F.xxhash64("doc_id").alias("o"))
    picked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(lang).orderBy("o", "w"))).where(F.col("_n") <= texts)
    sample = sorted(picked.collect(), key=lambda r: (r[lang], r["_n"]))
    return train([(r[lang], list(r["w"])) for r in sample])


def _slices(batch: pd.DataFrame, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    if len(batch):
        for _, part in batch.groupby(batch["_t"].str.len().to_numpy().cumsum() // characters):
            yield part


def _with_ids(docs: DataFrame, text: str, work, fields: str) -> DataFrame:
    """Run `work` over `(doc_id, _t)`. Ids pass as text, so that large ones beside nulls do not become floats."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = own.mapInPandas(work, f"doc_id string, {fields}")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. The model (about 1 MB for four languages) is sent with the tasks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Tagger(held.value)
        for batch in batches:
            for part in _slices(batch):
                found = tool.texts([words_of(t) for t in part["_t"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return _with_ids(docs, text, work, "lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: doc_id and its words (those with a letter, in lower case) with language and marginal."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Tagger(held.value)
        names = held.value.languages
        for batch in batches:
            for part in _slices(batch):
                texts = [words_of(t) for t in part["_t"]]
                out = [[] for _ in texts]
                if names:
                    gamma, sizes = tool.marginals(texts)
                    at = 0
                    for n, (words, size) in enumerate(zip(texts, sizes)):
                        kept = [w for w in words if tool.place[w] >= 0]
                        rows = gamma[at : at + size]
                        best = rows.argmax(axis=1)
                        out[n] = [{"word": w, "lang": names[b], "marginal": float(r[b])} for w, b, r in zip(kept, best, rows)]
                        at += size
                yield pd.DataFrame({"doc_id": part["doc_id"], "words": out})

    return _with_ids(docs, text, work, "words array<struct<word:string,lang:string,marginal:double>>")


def classify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; held-out ids are never trained on."""
    out = F.coalesce(part_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = fit(docs.where(~out), text, lang)
    return predict(docs, model, text).select("doc_id", out.alias("held_out"), "lang_pred", "score")
