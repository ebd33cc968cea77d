"""Readings as a stream: late rows, completeness of hours, and rolling sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import out_of_range


def read_stream(spark: SparkSession, path: str, schema: StructType, *, files_a_batch: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def on_time(stream: DataFrame, time: str = "DateTime", lateness: str = "30 minutes") -> DataFrame:
    """Rows may be so late. A watermark needs a time with a zone, so the local time is cast for it."""
    return stream.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", lateness)


def hourly_counts(stream: DataFrame, keys: tuple[str, ...] = ("Equipment", "Description")) -> DataFrame:
    """Rows and mean of each sensor and hour, given out once the hour is over and late rows are in."""
    return stream.groupBy(F.window("event_time", "1 hour"), *keys).agg(F.count("*").alias("rows"), F.avg("CurrValue").alias("mean")).select("window.start", "window.end", *keys, "rows", "mean")


def rule_alarms(stream: DataFrame) -> DataFrame:
    """Readings outside their class's valid range, as they come."""
    return stream.filter(out_of_range(F.col("Equipment"), F.col("CurrValue")))
