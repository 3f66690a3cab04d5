"""Readers of the Parquet tables and of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder; columns are pruned by the query that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
