"""An extension: tumbling bins of a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_bins(events: DataFrame, width: str = "4 days", late: str = "1 day") -> DataFrame:
    """(start, end, user_id, events, value) of each window that the watermark has passed (append mode)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "events", "value")
