"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table, read as it is. How finely a file is split is up to
    ``spark.sql.files.maxPartitionBytes`` and its row groups."""
    return spark.read.parquet(path)
