"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import centroids, licenses, minhash, mixing, nearest, negatives, packing, quality, secrets, sharding, substring_dedup, suffix_dedup, token_store
from logloom.llm.common import table


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op2_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, d, "documents"))


def op6_token_store(spark: SparkSession, d: str) -> DataFrame:
    return token_store.store_and_read(table(spark, d, "documents"))


def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.remove_windows(table(spark, d, "documents"))


def op9_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_records(table(spark, d, "documents"))


def op5_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(licenses.as_files(table(spark, d, "documents")))


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    taken = (F.col("size") * F.size("shards")).alias("taken")
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest(table(spark, d, "embeddings"))


def op11_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


def op12_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids.cluster(table(spark, d, "embeddings"))


def op13_negatives(spark: SparkSession, d: str) -> DataFrame:
    return negatives.mine(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op6_token_store, op7_substring_dedup, op9_minhash, op3_sharding, op5_licenses, op8_mixing, op4_quality, op10_nearest, op11_secrets, op12_centroids, op13_negatives)}
ORACLE: dict[str, str] = {"op5_licenses": licenses.SQL, "op12_centroids": centroids.SQL, "op13_negatives": negatives.SQL}
