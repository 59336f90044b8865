"""Input tables as the engine's abstractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, language, text): one row per document."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("lang").alias("language"), "text")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings(id, cwe, repo, file, line, severity, confidence, verified) projected from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("cwe"),
        F.col("l_suppkey").alias("repo"),
        F.col("l_partkey").alias("file"),
        F.col("l_linenumber").alias("line"),
        F.round(F.least(F.lit(10.0), F.col("l_quantity") / 5), 1).alias("severity"),
        F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"),
        (F.col("l_tax") >= 0.04).alias("verified"),
    )
