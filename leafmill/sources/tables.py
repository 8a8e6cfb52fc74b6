"""Table access: one Parquet file or directory per table below a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table `name` below `data_dir`; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
