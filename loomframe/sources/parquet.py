"""Parquet, read and written by Spark; bucketed tables for joins without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def save_bucketed(df: DataFrame, table: str, by: list[str], buckets: int, mode: str = "error") -> None:
    """A table whose joins and groupings on `by` need no exchange."""
    df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
