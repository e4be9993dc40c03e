"""The tables of a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Makes tables temporary views of their own names for spark.sql."""
    for name in names or TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def cents(column: str):
    """An amount as whole hundredths, so that sums don't depend on the order of rows."""
    return F.round(F.col(column) * 100).cast("long")
