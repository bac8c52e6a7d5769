"""Event streams: windowed sums with a watermark, over files as they come. Batch frames work too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of value by window and keys; rows later than the watermark are dropped by a stream."""
    if df.isStreaming:
        df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return df.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
