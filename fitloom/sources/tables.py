"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A stored table. ``partitions`` deals its rows out anew, for small tables in one row group whose
    rows are costly to work on; large ones have enough row groups."""
    df = spark.read.parquet(path)
    return df if partitions is None else df.repartition(partitions)
