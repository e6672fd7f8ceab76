"""Candles, vectors and runs from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candle for each brand and shipping day; the price of a line is its total over its quantity."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("p_brand").alias("symbol"),
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("q"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
    )
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "o").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"),
        F.sum("q").alias("volume"),
        (F.sum("cents") / 100).alias("amount"),
    )


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    n = F.substring_index("symbol", "#", -1).cast("int")
    return brands.select(
        "symbol", F.concat(F.lit("Brand "), n.cast("string")).alias("name"), F.concat(F.lit("sector "), (n % 5).cast("string")).alias("sector"), F.when(n % 2 == 0, "HOSE").otherwise("HNX").alias("exchange")
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ten-bit codes of each vector from the signs of its first twenty elements."""
    from wickflow.operators.tokens import bits_to_index

    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id", "label", bits_to_index(F.slice("embedding", 1, 10)).alias("s1"), bits_to_index(F.slice("embedding", 11, 10)).alias("s2")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))


#: Window length, portfolio size and least cross-section of the registered queries.
LEAST = {"lookback": 126, "top_k": 3, "min_symbols": 10}
TRAIN_END, VAL_END = "1999-01-01", "2000-07-01"
