"""Slices of runs: what depends on a sample's place, or on the samples before it, without one task for each run.

A run of many rows is cut into slices of about SLICE_ROWS rows by time. Windows sort within a slice; what a slice has to know of the
earlier ones (counts, sums, last values, open stretches) is a row for each slice, folded by a window over the slices of the run and
joined back. The rows are written to the shared folder once, for the passes that read them. Where the whole input is small by Catalyst's own statistics of its size, runs are not cut: a run is then one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..session import durable

#: Rows of a slice, and the bytes (by the statistics of the optimised plan) up to which an input is not cut.
SLICE_ROWS, SMALL_BYTES = 1 << 20, 16 << 20


def is_small(df: DataFrame) -> bool:
    """Whether Catalyst's size of the input allows no long run. What it can't estimate is taken for large. Nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES


def in_order(df: DataFrame) -> list[str]:
    """What rows of a run are sorted by: time, and within a time the number _nth where rows have one."""
    return ["x_ms", "_nth"] if "_nth" in df.columns else ["x_ms"]


@dataclass(frozen=True)
class Cut:
    """df with the columns (keys) whose rows are sorted together: those of the run, or a struct of them and the slice."""

    df: DataFrame
    keys: list[str]
    sliced: bool

    def ordered(self, *order: str) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*(order or in_order(self.df)))

    def upto(self, *order: str) -> WindowSpec:
        return self.ordered(*order).rowsBetween(Window.unboundedPreceding, 0)

    def before(self, *order: str) -> WindowSpec:
        return self.ordered(*order).rowsBetween(Window.unboundedPreceding, -1)

    def latest(self, value: str | Column, counts: Column | None = None) -> Column:
        """Aggregate: the value of the last row, or of the last that counts."""
        at = F.struct(*in_order(self.df))
        return F.max_by(value, at if counts is None else F.when(counts, at))

    def with_columns(self, columns: dict[str, Column]) -> Cut:
        return Cut(self.df.withColumns(columns), self.keys, self.sliced)

    def over_run(self, totals: dict[str, Column]) -> Cut:
        """Adds aggregates of the whole run."""
        if not self.sliced:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({k: c.over(whole) for k, c in totals.items()})
        own = self.df.groupBy("_key").agg(*[c.alias(k) for k, c in totals.items()])
        return Cut(self.df.join(own, "_key"), self.keys, True)

    def carried(self, summary: dict[str, Column], states: Callable[[DataFrame], dict[str, Column]], nothing: dict[str, Column]) -> Cut:
        """Adds what each slice has to know of the earlier slices of its run.

        summary: aggregates of a slice; states: from the frame of the slices (a row for each, with _key and _slice) the columns, by windows
        over the slices of a run. An uncut run knows nothing: it has the columns of `nothing`.
        """
        if not self.sliced:
            return self.with_columns(nothing)
        own = self.df.groupBy("_key", "_slice").agg(*[c.alias(k) for k, c in summary.items()])
        known = own.select("_key", "_slice", *[c.alias(k) for k, c in states(own).items()])
        return Cut(self.df.join(known, ["_key", "_slice"]), self.keys, True)

    def plain(self, *drop: str) -> DataFrame:
        return self.df.drop("_key", "_slice", *drop)


def earlier(frame: int = -1) -> WindowSpec:
    """The earlier slices of a run (or, with 0, this one too)."""
    return Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, frame)


def cut(df: DataFrame, by: list[str]) -> Cut:
    """Rows with x_ms, by runs of the columns `by`, which may be null. Slices are even in time; runs of SLICE_ROWS or fewer are one."""
    if is_small(df):
        return Cut(df, list(by), False)
    # structs with equal fields are equal, nulls included, so that a join on them is a plain one; written, as several passes read it
    df = durable(df.withColumn("_key", F.struct(*by)))
    spans = df.groupBy("_key").agg(F.count("*").alias("_rows"), F.min("x_ms").alias("_x0"), F.max("x_ms").alias("_x1"))
    width = (F.col("_x1") - F.col("_x0")) / F.ceil(F.col("_rows") / SLICE_ROWS)
    long = spans.where((F.col("_rows") > SLICE_ROWS) & (F.col("_x1") > F.col("_x0"))).select("_key", "_x0", width.alias("_width"))
    at = F.floor((F.col("x_ms") - F.col("_x0")) / F.col("_width"))
    met = df.join(long, "_key", "left").withColumn("_slice", F.coalesce(at, F.lit(0).cast("long"))).drop("_x0", "_width")
    return Cut(met, ["_key", "_slice"], True)


def ranked(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """df with _place, the row's number in its run from 0, and _n, the rows of the run. order begins with x_ms."""
    c = cut(df, by)
    if not c.sliced:
        rows = c.with_columns({"_place": (F.row_number().over(c.ordered(*order)) - 1).cast("long")})
        return rows.over_run({"_n": F.count(F.lit(1))}).df
    own = durable(c.df.groupBy("_key", "_slice").agg(F.count("*").alias("_own")))
    ahead = F.coalesce(F.sum("_own").over(earlier()), F.lit(0).cast("long"))
    known = own.select("_key", "_slice", ahead.alias("_ahead"), F.sum("_own").over(Window.partitionBy("_key")).alias("_n"))
    # so many partitions that a task sorts about one slice; adaptive execution would merge slices that compress well, but not under a given number
    slices = math.ceil((own.agg(F.sum("_own")).first()[0] or 0) / SLICE_ROWS)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * slices)
    dealt = c.df.join(known, ["_key", "_slice"]).repartition(parts, "_key", "_slice")
    return Cut(dealt, c.keys, True).with_columns({"_place": F.col("_ahead") + F.row_number().over(c.ordered(*order)) - 1}).plain("_ahead")


def rolling(df: DataFrame, by: list[str], width: int, out: str, reduce: Callable[[WindowSpec], Column]) -> DataFrame:
    """Adds the reduction of the last `width` rows of the run. Long runs are cut into blocks of rows that begin with a halo of the
    width - 1 rows before them."""
    frame = lambda w: w.rowsBetween(-(width - 1), 0)
    if is_small(df):
        return df.withColumn(out, reduce(frame(Window.partitionBy(*by).orderBy(*in_order(df)))))
    rows = ranked(df, by, *in_order(df)).withColumn("_key", F.struct(*by)).withColumn("_block", F.floor(F.col("_place") / SLICE_ROWS))
    last = F.floor(F.least(F.col("_place") + (width - 1), F.col("_n") - 1) / SLICE_ROWS)
    copied = rows.withColumn("_in", F.explode(F.sequence("_block", last)))
    done = copied.withColumn(out, reduce(frame(Window.partitionBy("_key", "_in").orderBy("_place"))))
    return done.where(F.col("_in") == F.col("_block")).drop("_key", "_block", "_in", "_place", "_n")


def seconds_before(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds the seconds since the row before, 0 for the first."""
    c = cut(df, by).carried({"_last": F.max("x_ms")}, lambda s: {"_last": F.max("_last").over(earlier())}, {"_last": F.lit(None).cast("double")})
    gap = (F.col("x_ms") - F.coalesce(F.lag("x_ms").over(c.ordered()), F.col("_last"))) / 1000
    return c.with_columns({out: F.coalesce(F.greatest(F.lit(0.0), gap), F.lit(0.0))}).plain("_last")


def integral(df: DataFrame, by: list[str], value: str, counts: str, seconds: str, out: str) -> DataFrame:
    """Adds the sum, from the first row on, of the trapezes between rows that count (a boolean column) and the last before them that does."""
    c = cut(df, by)
    own = F.when(F.col(counts), F.col(value))
    c = c.carried(
        {"_last": c.latest(value, F.col(counts))}, lambda s: {"_last": F.last("_last", ignorenulls=True).over(earlier())},
        {"_last": F.lit(None).cast("double")},
    )
    last = F.coalesce(F.last(own, ignorenulls=True).over(c.before()), F.col("_last"))
    part = F.when(F.col(counts) & last.isNotNull() & (F.col(seconds) > 0), (last + F.col(value)) * 0.5 * F.col(seconds)).otherwise(0.0)
    c = c.with_columns({"_part": part})
    c = c.carried({"_sum": F.sum("_part")}, lambda s: {"_ahead": F.coalesce(F.sum("_sum").over(earlier()), F.lit(0.0))}, {"_ahead": F.lit(0.0)})
    return c.with_columns({out: F.col("_ahead") + F.sum("_part").over(c.upto())}).plain("_last", "_part", "_ahead")


def completed(c: Cut, inside: Column, hit: Column, complete: Callable[[Column, Column], Column], seconds: Callable[[Column], Column], out: str) -> DataFrame:
    """c's rows with the seconds of the last completed stretch, 0 before the first.

    A stretch is an unbroken run of rows inside. It is completed by its first row that hits and for which complete(time, start of the stretch)
    holds, and holds for all later times if for one; seconds(start) are then held. Of an earlier slice a slice knows the start of the
    stretch that is open at its end, that stretch's last hit, and the seconds held.
    """
    x = F.col("x_ms")
    null = F.lit(None).cast("double")
    c = c.with_columns({"_in": F.coalesce(inside, F.lit(False))}).with_columns({"_hit": F.when(F.col("_in") & hit, x), "_outside": F.when(~F.col("_in"), x)})
    c = c.with_columns({"_begin": F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(c.ordered()), F.lit(False)), x)})
    c = c.with_columns({"_start": F.when(F.col("_in"), F.last("_begin", ignorenulls=True).over(c.upto())), "_left": F.max("_outside").over(c.upto()), "_hits": F.max("_hit").over(c.before())})

    if c.sliced:
        own = c.df.groupBy("_key", "_slice").agg(c.latest("_start").alias("_tail"), F.max("_hit").alias("_top"), F.count("_outside").alias("_breaks"))
        own = own.withColumn("_group", F.sum((F.col("_breaks") > 0).cast("int")).over(earlier(0)))
        # the slices since the last that has a row outside, which says where the open stretch began
        since = Window.partitionBy("_key", "_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumns({"_open": F.first("_tail", ignorenulls=True).over(since), "_last_hit": F.max("_top").over(since)})
        order = Window.partitionBy("_key").orderBy("_slice")
        known = own.select("_key", "_slice", F.lag("_open").over(order).alias("_open"), F.lag("_last_hit").over(order).alias("_last_hit"))
        c = Cut(c.df.join(known, ["_key", "_slice"]), c.keys, True)
        lead = F.col("_left").isNull()
        start = F.when(F.col("_in"), F.coalesce(F.when(lead, F.col("_open")), F.col("_start")))
        c = c.with_columns({"_start": start, "_hits": F.greatest(F.col("_hits"), F.when(lead, F.col("_last_hit")))})
    begun = F.col("_start")
    is_done = (F.col("_hits") >= begun) & complete(F.col("_hits"), begun)
    event = F.when(F.col("_hit").isNotNull() & complete(x, begun) & ~F.coalesce(is_done, F.lit(False)), seconds(begun))
    c = c.with_columns({"_event": event})
    c = c.carried(
        {"_held": c.latest("_event", F.col("_event").isNotNull())}, lambda s: {"_held": F.last("_held", ignorenulls=True).over(earlier())}, {"_held": null},
    )
    c = c.with_columns({out: F.coalesce(F.last("_event", ignorenulls=True).over(c.upto()), F.col("_held"), F.lit(0.0))})
    return c.plain("_in", "_hit", "_outside", "_begin", "_start", "_left", "_hits", "_open", "_last_hit", "_event", "_held")
