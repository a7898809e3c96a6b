"""An extension: hourly rollups of events, in batch and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """hour, event_type, n, total. For a stream call ``streamed`` first."""
    made = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return made.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def streamed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The stream with its watermark: later rows than that are dropped, and hours before it are final."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # a watermark needs a time zone
