"""Parquet storage for embedded records and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_embedded(records: DataFrame, path: str) -> DataFrame:
    """Write records with their vectors (as floats) and read them back as a restart point."""
    records.withColumn("v", F.col("v").cast("array<float>")).write.mode("overwrite").parquet(path)
    return read_embedded(records.sparkSession, path)


def read_embedded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_matches(matches: DataFrame, path: str) -> None:
    matches.select("a_id", "b_id", "p1", "p2", "label").write.mode("overwrite").parquet(path)
