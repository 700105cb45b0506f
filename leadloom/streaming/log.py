"""The status log as a stream (an extension: the reference has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deduplicated(events: DataFrame, id_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Each id once; ids older than the watermark are forgotten, so the state is bounded."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts per window and key; late rows within the watermark are still counted."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
