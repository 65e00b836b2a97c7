import hashlib
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from corpusq.llm import bpe_tree, credentials, quality_rules
from tests.llm.test_credentials import brute as secrets_of
from tests.llm.test_decontaminate import brute as leaks_of

WORDS = "river stone cloud garden window yellow quiet morning paper travel letter simple market village bridge music".split()
BENCH = [(0, "seven brown foxes jumped across the frozen lake while nobody in the old town was watching them at all")]


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(r.integers(1000)) for k in r.integers(len(WORDS), size=n)) + "."


def rows():
    long = prose(1, 400)
    out = [(i, prose(i)) for i in range(10, 22)]
    out += [(1, long), (2, long), (3, long + "."), (4, prose(1, 400).upper()), (5, "too short"), (6, None), (7, "")]
    out += [(8, prose(8) + " " + BENCH[0][1]), (9, prose(9) + '\ntoken = "0123456789abcdef0123456789abcdef"')]
    out += [(30, "| ".join(prose(30).split())), (31, "same line again and again\n" * 30), (None, prose(40)), (12, prose(12)), (32, prose(32, 12_000))]
    return out


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 20:
        return False
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 5_000 else set()
    chars = sum(map(len, w))
    lines = [x for x in text.split("\n") if x.strip()]
    return not (
        100 * len(covered) > 30 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 2 * len(w)
        or 10 * text.count("!") > 2 * len(w) or 10 * sum(c.isupper() for c in text) > 4 * chars
        or chars < 2 * len(w) or chars > 20 * len(w) or 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * len(w)
        or (len(lines) >= 10 and 10 * (len(lines) - len(set(lines))) > 5 * len(lines))
    )


def expected(docs):
    kept = [(i, t) for i, t in docs if good(t)]
    prints = [fingerprint(t) for _, t in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for n, g in enumerate(group):
        key = (kept[n][0] is None, kept[n][0] or 0, n)
        first[g] = min(first.get(g, key), key)
    kept = [kept[n] for *_, n in first.values()]
    leaked = {i for i, *_ in leaks_of(kept, BENCH)}
    out = []
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(bpe_tree.default_path())
    for i, t in kept:
        if str(i) in leaked:
            continue
        new, at = "", 0
        for a, b in (tuple(map(int, s.split(":")[1:])) for s in secrets_of(t)[4].split(",") if s):
            new, at = new + (t[at:a] + credentials.MARK if a >= at else ""), max(at, b)
        new += t[at:]
        ids = np.array(tool.encode(new, add_special_tokens=False).ids, dtype="<u4")
        out.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(
        [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows()],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_equals_brute_force(spark, folder):
    found = cp.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected(rows())
    ids = {r["doc_id"] for r in found}
    assert {1, 9, 10, 12, 32, None} <= ids and not ids & {2, 3, 4, 5, 6, 7, 8, 30, 31}
    assert sum(r["doc_id"] == 12 for r in found) == 1


def test_stages_keep_the_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for n, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == names and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"s{n}"))
        docs = spark.read.parquet(str(tmp_path / f"s{n}"))


def test_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_stages_follow_the_rules():
    assert quality_rules.STRICT.mask() & quality_rules.BASE.mask() == quality_rules.BASE.mask()
    assert [n for n, _ in cp.STAGES][0] == "quality_rules" and len(cp.STAGES) == 5


def test_chained_stages_keep_what_is_still_read(spark, tmp_path):
    """Two stages before any action, and a second run beside them: nobody's scratch is deleted while it is read."""
    rows = [(i, f"plain words number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stored = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = cp.near_duplicates(spark, stored, str(tmp_path))
    second = cp.leaks(spark, first, str(tmp_path))
    third = cp.secrets(spark, second, str(tmp_path))
    assert cp.run(spark, str(tmp_path)).count() == 6
    assert third.count() == 6
