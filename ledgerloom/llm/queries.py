"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import common, decontaminate, differencing, dual_tree, fingerprint, langid, ngram_join, oracles, packing, prefix_trie, quality, secret_scan, sharding, suffix, tokenfile
from ledgerloom.llm.scratch import short_batches


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode(common.documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(common.documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(common.documents(spark, sf_dir))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(common.documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "score", "keep")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(common.documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.pack(common.documents(spark, sf_dir))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return dual_tree.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_tokenfile, op3_ngram_join, op4_decontaminate, op5_fingerprint, op6_secrets, op7_suffix, op8_quality, op9_sharding, op10_packing, op11_windows, op12_negatives, op13_trie)}
ORACLE_SQL = {"op12_negatives": oracles.HARD_NEGATIVES, "op13_trie": oracles.PREFIX_TRIE}
