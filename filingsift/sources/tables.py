"""The project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; Spark prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
