"""Schemas of the series and of the catalog's dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = "test_run_id long, test_run_code string, channel_name string, unit string, x_ms double, y double"
SERIES_COLUMNS = ["test_run_id", "test_run_code", "channel_name", "unit", "x_ms", "y"]
KEY = ["test_run_id", "channel_name"]

TESTS = (
    "test_id long, artifact_id string, run_code string, source_path string, source_type string, status string, "
    "start_time timestamp, end_time timestamp, duration_s double, created_at timestamp, notes string, catalog string, rule string, "
    "source_size long, source_modified timestamp"
)
CHANNELS = "test_id long, channel_name string, display_name string, unit string, parquet_uri string, point_count long, start_ms double, end_ms double"
PARAMETERS = "test_id long, key string, value_text string, value_num double"
RANGES = (
    "range_id long, test_id long, parent_range_id long, name string, kind string, start_ms double, end_ms double, "
    "tags array<string>, source string, rule_id long, notes string, created_at timestamp, label string, status string, color string, updated_at timestamp"
)
RANGE_PARAMETERS = "range_id long, key string, value_text string, value_num double"
RANGE_RULES = "rule_id long, name string, kind string, channel_name string, config string, default_label string, default_color string"
RESULTS = "result_id long, test_id long, range_id long, analysis_name string, key string, value_text string, value_num double"


def series_from_events(events: DataFrame, channels_of_all: bool = False) -> DataFrame:
    """events as series: a run for each user (or one run in all) and a channel for each event type."""
    run = F.lit(0).cast("long") if channels_of_all else F.col("user_id")
    return events.select(
        run.alias("test_run_id"),
        F.concat(F.lit("run-"), run.cast("string")).alias("test_run_code"),
        F.col("event_type").alias("channel_name"),
        F.lit("u").alias("unit"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("x_ms"),
        F.col("value").cast("double").alias("y"),
    )


def finite(column):
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
