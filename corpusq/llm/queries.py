"""The registered queries of the subpackage: `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import (
    bpe_tree, conversation_trie, credentials, decontaminate, hilbert, language_crf, licenses, minhash_forest, quality_qda,
    quality_rules, simhash_vp, token_alignment, token_store,
)
from corpusq.llm.common import read


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality_rules.ledger(read(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policies(held, (quality_rules.BASE, quality_rules.STRICT))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col(f"`{quality_rules.BASE.version}`")).alias("base_failed"),
        F.col(f"`{quality_rules.STRICT.version}`").alias("kept"), "failures",
    )


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(read(spark, sf_dir, "documents"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(read(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    store = token_store.write_store(docs)
    return token_store.read_digests(store, docs.select("doc_id").distinct())


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(read(spark, sf_dir, "documents"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find(read(spark, sf_dir, "documents"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.classify(read(spark, sf_dir, "documents"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_qda": op1_quality_qda,
    "op2_licenses": op2_licenses,
    "op3_quality_rules": op3_quality_rules,
    "op4_hilbert": op4_hilbert,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_token_store": op6_token_store,
    "op7_simhash_vp": op7_simhash_vp,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_credentials": op9_credentials,
    "op10_language_crf": op10_language_crf,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
