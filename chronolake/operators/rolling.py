"""Rolling channels: trailing windows over the last samples of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schema import SERIES_COLUMNS, finite
from .slices import rolling

#: Reductions of a frame: of channels the sample deviation, of formulas the population deviation.
REDUCTIONS = {
    "mean": F.avg, "smooth": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "std_pop": F.stddev_pop,
    "rms": lambda c: F.sqrt(F.avg(c * c)), "peak": lambda c: F.max(F.abs(c)),
}


def trailing(df: DataFrame, column: Column, op: str, width: int, out: str, by: list[str]) -> DataFrame:
    """Adds the reduction of the last `width` rows of a run in time order."""
    def reduced(frame: WindowSpec) -> Column:
        if op == "rms":
            return F.sqrt(F.avg(column * column).over(frame))
        if op == "peak":
            return F.max(F.abs(column)).over(frame)
        return REDUCTIONS[op](column).over(frame)

    return rolling(df, by, max(1, int(width)), out, reduced)


def rolling_channel(series: DataFrame, channel: str, op: str, width: int, name: str, unit: str | None = None) -> DataFrame:
    """The channel's trailing mean, sum, min, max or std by run as a new channel; results that are null or not finite go."""
    own = series.where(F.col("channel_name") == channel)
    out = trailing(own, F.col("y"), op, width, "_out", ["test_run_id"]).withColumn("y", F.col("_out"))
    return out.where(finite(F.col("y"))).withColumns({"channel_name": F.lit(name), "unit": F.lit(unit).cast("string")}).select(*SERIES_COLUMNS)
