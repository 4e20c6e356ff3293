"""Readers of the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; its columns and filters are pruned into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
