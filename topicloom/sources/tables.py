"""Table access: every scan of the engine goes through here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root` (one file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
