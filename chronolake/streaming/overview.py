"""Bucket averages of a stream: an event-time window with a watermark, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_average_stream(samples: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """samples(test_run_id, channel_name, time, y) -> mean and count of each window once the watermark has passed it."""
    windows = samples.withWatermark("time", late).groupBy("test_run_id", "channel_name", F.window("time", width))
    averaged = windows.agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    return averaged.select("test_run_id", "channel_name", (F.unix_micros("window.start") / 1000).alias("x_ms"), "y", "n")
