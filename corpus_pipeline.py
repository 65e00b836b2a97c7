"""The training-data pipeline: quality rules, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes the rows its predecessor kept. The first three drop documents, the fourth replaces secrets in the
texts, the last encodes what is left. A stage's scratch folders are released when the next stage of the same run begins, for by then its
result has been written and reread; a folder that the next stage's input still reads is kept. `run` has a list of its own, so runs
beside each other do not meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusq.llm import bpe_tree, credentials, decontaminate, quality_rules, simhash_vp
from corpusq.llm.common import read
from corpusq.session import materialize, release, scratch_scope, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Words a worker of the token stage remembers: workers outlive their stage, and their memory adds to that of the next ones.
REMEMBERED = 100_000
# Scratch of the stage before, where stages are called one by one: by session and data folder.
_FINISHED: dict[tuple[str, str], list[str]] = {}


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, finished: list[str] | None = None) -> DataFrame:
        ship_package(spark)
        if finished is None:
            finished = _FINISHED.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        _release_unread(finished, docs)
        with scratch_scope() as paths:
            out = function(spark, docs, sf_dir)
        finished.extend(paths)
        return out

    return run_stage


def _release_unread(paths: list[str], docs: DataFrame) -> None:
    """Release the folders that `docs` does not read; the others stay in the list."""
    read = "\n".join(docs.inputFiles()) if paths else ""
    names = {p: p.rpartition("/")[2] for p in paths}
    kept = [p for p in paths if names[p] in read]
    release([p for p in paths if names[p] not in read])
    paths[:] = kept


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy keeps."""
    return quality_rules.keep(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints, the one with the smallest id."""
    return simhash_vp.keep_one(docs)


@_stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return credentials.redact(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe_tree.digests(docs, cache=REMEMBERED)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", leaks),
    ("secret_scans", secrets),
    ("bpe_tokens", tokens),
]

# Fingerprint components and token ids are beyond SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held: list[str] = []
    finished: list[str] = []  # of this run
    for name, stage in STAGES:
        with scratch_scope() as paths:
            docs = materialize(stage(spark, docs, sf_dir, finished), f"pipeline-{name}")
        release(held)  # the copy that this stage has read
        held = [p for p in paths if f"/pipeline-{name}-" in p]
    release(finished)
    return docs
