"""Sparse rows built from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources.rows import from_dense, from_long, from_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer who ordered; a part's value is its summed quantity."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return from_long(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_partkey", "l_quantity")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; a token's value is its count, its feature the first
    six hexadecimal digits of its md5."""
    words = F.split(F.lower("text"), r"[^\p{L}]+").alias("words")
    return from_words(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
