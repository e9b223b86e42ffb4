"""Views over events and cursors: envelopes around events, values at cursors, resampling and residuals, densities."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY, SERIES_COLUMNS, finite
from .slices import cut, earlier


def quantiles(counts: DataFrame, by: list[str], shares: list[Fraction], others: dict[str, Column] | None = None) -> DataFrame:
    """(by, quantiles, ...): the exact quantiles of counts(by, y, n), which has the rows of each value counted, and other aggregates of it.

    A quantile is the least value up to which there are at least its share of the group's rows. Values are summed up in order, by slices where a
    group has many different ones.
    """
    c = cut(counts.withColumnRenamed("y", "x_ms"), by)
    zero = F.lit(0).cast("long")
    c = c.carried({"_own": F.sum("n")}, lambda s: {"_ahead": F.coalesce(F.sum("_own").over(earlier()), zero)}, {"_ahead": zero}).over_run({"_all": F.sum("n")})
    rows = c.with_columns({"_upto": F.col("_ahead") + F.sum("n").over(c.upto())}).df.withColumn("y", F.col("x_ms"))
    # whole numbers, as 0.1 * 70 is more than 7
    reached = [F.col("_upto").cast("decimal(20,0)") * F.lit(Decimal(s.denominator)) >= F.col("_all").cast("decimal(20,0)") * F.lit(Decimal(s.numerator)) for s in shares]
    found = F.array(*[F.min(F.when(r, F.col("y"))) for r in reached])
    return rows.groupBy(*by).agg(found.alias("quantiles"), *[a.alias(k) for k, a in (others or {}).items()])


def event_samples(series: DataFrame, events: DataFrame, before_ms: float, after_ms: float) -> DataFrame:
    """The samples in [at - before_ms, at + after_ms] of each event(event_id, test_run_id, at_ms) of their run, with event_id and rel_ms.

    Windows may overlap; a sample then stands once for each event. Samples and windows meet by time slots of a window's length, of which a window
    touches two, so the join is by equal slots and no run is compared with all its events.
    """
    width = before_ms + after_ms
    if before_ms < 0 or after_ms < 0 or width <= 0:
        raise ValueError("a window needs a length")
    slot = lambda c: F.floor(c / F.lit(float(width)))
    start = F.col("at_ms") - before_ms
    own = events.where(F.col("at_ms").isNotNull()).select("event_id", "test_run_id", "at_ms", F.explode(F.sequence(slot(start), slot(F.col("at_ms") + after_ms))).alias("_slot"))
    met = series.where(finite(F.col("y"))).withColumn("_slot", slot(F.col("x_ms"))).join(own, ["test_run_id", "_slot"])
    met = met.withColumn("rel_ms", F.col("x_ms") - F.col("at_ms")).where(F.col("rel_ms").between(-before_ms, after_ms))
    return met.select("event_id", *SERIES_COLUMNS, "rel_ms")


def event_envelope(series: DataFrame, events: DataFrame, before_ms: float, after_ms: float, bin_ms: float, percentiles: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(channel_name, bin_ms, n, n_events, min_y, mean_y, max_y, low_y, high_y): what the windows of all events have in each bin of time
    relative to their event.

    Values are counted before the shuffle, and percentiles are exact. Events are counted after a first step by event.
    """
    rows = event_samples(series, events, before_ms, after_ms).withColumn("bin_ms", F.floor(F.col("rel_ms") / bin_ms) * F.lit(float(bin_ms)))
    by = ["channel_name", "bin_ms"]
    counts = rows.groupBy(*by, "y").agg(F.count("*").alias("n"))
    others = {"n": F.sum("n"), "min_y": F.min("y"), "mean_y": F.sum(F.col("y") * F.col("n")) / F.sum("n"), "max_y": F.max("y")}
    out = quantiles(counts, by, [Fraction(str(p)) for p in percentiles], others)
    events_of = rows.groupBy(*by, "event_id").agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n_events"))
    return out.join(events_of, by).select(*by, "n", "n_events", "min_y", "mean_y", "max_y", F.col("quantiles")[0].alias("low_y"), F.col("quantiles")[1].alias("high_y"))


def neighbours(marks: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """marks(by, x_ms, ...) with `before`, the last sample(by, x_ms, y) at or before each mark, and `after`, the first behind it: structs of x_ms and y.

    Of samples of one time the greatest y comes last. Marks are sorted among the samples: one sort by run and time, and long runs are cut into
    slices that know the last sample of the earlier ones and the first of the later ones. Samples whose y is not finite are passed over.
    """
    point = F.struct("x_ms", "y")
    known = samples.where(finite(F.col("y"))).select(*by, "x_ms", point.alias("_point"), F.col("y").alias("_y"))
    fields = [f for f in marks.columns if f not in (*by, "x_ms")]
    own = marks.select(*by, "x_ms", F.struct(F.lit(1).alias("_one"), *fields).alias("_mark"))
    both = known.unionByName(own, allowMissingColumns=True).withColumn("_side", F.col("_point").isNull().cast("int"))
    c = cut(both, by)
    none = F.lit(None).cast("struct<x_ms:double,y:double>")
    later = Window.partitionBy("_key").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    order = ("x_ms", "_side", "_y")
    c = c.carried(
        {"_last": F.max("_point"), "_first": F.min("_point")},
        lambda s: {"_earlier": F.last("_last", ignorenulls=True).over(earlier()), "_later": F.first("_first", ignorenulls=True).over(later)},
        {"_earlier": none, "_later": none},
    )
    ahead = c.ordered(*order).rowsBetween(1, Window.unboundedFollowing)
    c = c.with_columns({
        "before": F.coalesce(F.last("_point", ignorenulls=True).over(c.upto(*order)), F.col("_earlier")),
        "after": F.coalesce(F.first("_point", ignorenulls=True).over(ahead), F.col("_later")),
    })
    return c.df.where("_side = 1").select(*by, "x_ms", *[F.col("_mark")[f].alias(f) for f in fields], "before", "after")


def interpolated(max_gap_ms: float | None = None) -> Column:
    """The value at x_ms on the line from `before` to `after`; a sample at the very time is taken as it is. Null outside the samples, and between samples
    that are farther apart than the gap."""
    a, b, x = F.col("before"), F.col("after"), F.col("x_ms")
    gap = b["x_ms"] - a["x_ms"]
    near = F.lit(True) if max_gap_ms is None else gap <= max_gap_ms
    return F.when(a["x_ms"] == x, a["y"]).when(near, a["y"] + (b["y"] - a["y"]) * ((x - a["x_ms"]) / gap))


def cursor_values(series: DataFrame, cursors: DataFrame) -> DataFrame:
    """cursors(cursor_id, test_run_id, at_ms) over all channels of their run: the interpolated y, and delta_ms and delta_y to the cursor before.

    A row for each cursor and channel of its run; y is null outside the channel's samples, and a delta is null without both values.
    """
    runs = series.select(*KEY).distinct()
    marks = cursors.join(runs, "test_run_id").select(*KEY, F.col("at_ms").alias("x_ms"), "cursor_id")
    found = neighbours(marks, series, KEY).withColumn("y", interpolated())
    by = Window.partitionBy(*KEY).orderBy("x_ms", "cursor_id")  # cursors only
    deltas = {"delta_ms": F.col("x_ms") - F.lag("x_ms").over(by), "delta_y": F.col("y") - F.lag("y").over(by)}
    return found.withColumns(deltas).select("cursor_id", *KEY, F.col("x_ms").alias("at_ms"), "y", "delta_ms", "delta_y")


def residual(series: DataFrame, a: str, b: str, max_gap_ms: float | None = None) -> DataFrame:
    """(test_run_id, x_ms, a, b, residual): channel a minus channel b, which is interpolated at the times of a, whatever its clock.

    Times outside b, or in a gap of b that is longer than max_gap_ms, have no row.
    """
    of = lambda name: series.where((F.col("channel_name") == name) & finite(F.col("y"))).select("test_run_id", "x_ms", "y")
    met = neighbours(of(a).withColumnRenamed("y", "a"), of(b), ["test_run_id"]).withColumn("b", interpolated(max_gap_ms))
    return met.where(F.col("b").isNotNull()).select("test_run_id", "x_ms", "a", "b", (F.col("a") - F.col("b")).alias("residual"))


def resampled(series: DataFrame, step_ms: float, max_gap_ms: float | None = None) -> DataFrame:
    """Each series at the multiples of step_ms within its samples, interpolated; what lies in a longer gap than max_gap_ms is left out.

    Series of different clocks have common times then, so that formulas can align them.
    """
    # by code and unit first: an aggregate of strings makes every task sort all rows that it reads
    spans = series.where(finite(F.col("y"))).groupBy(*KEY, "test_run_code", "unit").agg(F.min("x_ms").alias("_a"), F.max("x_ms").alias("_z"))
    spans = spans.groupBy(*KEY).agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.max("test_run_code").alias("test_run_code"), F.max("unit").alias("unit"))
    first, last = F.ceil(F.col("_a") / step_ms), F.floor(F.col("_z") / step_ms)
    # in stretches, so that no row holds all steps of a long series
    chunk = 4096
    pieces = spans.where(first <= last).withColumn("_from", F.explode(F.sequence(first, last, F.lit(chunk).cast("long")))).withColumn("_to", F.least(F.col("_from") + (chunk - 1), last))
    steps = pieces.withColumn("_step", F.explode(F.sequence("_from", "_to"))).withColumn("x_ms", F.col("_step") * F.lit(float(step_ms)))
    met = neighbours(steps.select(*KEY, "x_ms", "test_run_code", "unit"), series, KEY).withColumn("y", interpolated(max_gap_ms))
    return met.where(F.col("y").isNotNull()).select(*SERIES_COLUMNS)


def density(series: DataFrame, time_bins: int, value_bins: int, even: bool = True) -> DataFrame:
    """(channel_name, time_bin, value_bin, n, n_runs): how many samples and runs fall into each cell of each channel's time and value; empty
    cells have no row.

    A first pass finds each channel's bounds: bins of time are even, bins of value too, or (even=False) between exact quantiles, so that each has
    about as many samples. A channel without a span has one bin. Cells are summed by run first, so that runs need no set.
    """
    if time_bins < 1 or value_bins < 1:
        raise ValueError("there must be a bin")
    rows = series.where(finite(F.col("y")) & F.col("x_ms").isNotNull()).select("test_run_id", "channel_name", "x_ms", "y")
    bounds = rows.groupBy("channel_name").agg(F.min("x_ms").alias("_x0"), F.max("x_ms").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    if not even:
        counts = rows.groupBy("channel_name", "y").agg(F.count("*").alias("n"))
        edges = quantiles(counts, ["channel_name"], [Fraction(k, value_bins) for k in range(1, value_bins)])
        same = F.col("_name").eqNullSafe(F.col("channel_name"))
        bounds = bounds.join(edges.select(F.col("channel_name").alias("_name"), F.col("quantiles").alias("_edges")), same).drop("_name")

    def even_bin(c: str, low: str, high: str, bins: int) -> Column:
        at = F.floor((F.col(c) - F.col(low)) / (F.col(high) - F.col(low)) * bins)
        return F.when(F.col(high) > F.col(low), F.least(at, F.lit(bins - 1).cast("long"))).otherwise(F.lit(0).cast("long"))

    value = even_bin("y", "_y0", "_y1", value_bins)
    if not even:
        value = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("y"))), F.lit(0)).cast("long")
    placed = rows.join(F.broadcast(bounds), "channel_name")  # a row for each channel
    placed = placed.select("test_run_id", "channel_name", even_bin("x_ms", "_x0", "_x1", time_bins).alias("time_bin"), value.alias("value_bin"))
    cells = placed.groupBy("channel_name", "time_bin", "value_bin", "test_run_id").agg(F.count("*").alias("n"))
    return cells.groupBy("channel_name", "time_bin", "value_bin").agg(F.sum("n").alias("n"), F.count("*").alias("n_runs"))
