"""Export of series: long CSV and Parquet, JSON rows, Arrow IPC for results of viewport size."""

from __future__ import annotations

import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES_COLUMNS


def iso_utc(x: Column) -> Column:
    """Epoch numbers (milliseconds above 1e11, else seconds) as ISO-8601 with Z; no fraction where it is zero."""
    micros = F.round(F.when(x > 1e11, x * 1000).otherwise(x * 1_000_000)).cast("long")
    at = F.timestamp_micros(micros)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.isnan(x) | x.isNull(), "").when(micros % 1_000_000 == 0, F.concat(whole, F.lit("Z"))).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def long_rows(series: DataFrame) -> DataFrame:
    """time_utc, source, channel, value, unit; values that are null or NaN are left out."""
    kept = series.where(F.col("y").isNotNull() & ~F.isnan("y"))
    return kept.select(
        iso_utc(F.col("x_ms")).alias("time_utc"), F.coalesce("test_run_code", F.lit("")).alias("source"), F.coalesce("channel_name", F.lit("channel")).alias("channel"),
        F.col("y").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"),
    )


def safe_filename(name: str, extension: str = "") -> str:
    """A file name of letters, digits, dots, dashes and underscores; `export` where nothing is left."""
    cleaned = re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip()).strip("._") or "export"
    return cleaned if cleaned.lower().endswith(extension.lower()) else cleaned + extension


def export_series(series: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes long rows as csv, or as parquet with zstd; each task writes its own file."""
    writer = long_rows(series).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown export {kind!r}")


def json_rows(series: DataFrame) -> DataFrame:
    return series.select(F.to_json(F.struct(*SERIES_COLUMNS)).alias("json"))


def arrow_ipc(series: DataFrame) -> bytes:
    """An Arrow stream of series that were reduced to a viewport: the point cap bounds what comes to the driver."""
    table = series.select(*SERIES_COLUMNS).orderBy("test_run_id", "channel_name", "x_ms").toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_arrow_ipc(data: bytes) -> pa.Table:
    table = pa.ipc.open_stream(data).read_all()
    if missing := [c for c in SERIES_COLUMNS if c not in table.column_names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return table
