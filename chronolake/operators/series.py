"""Operators on series: windows, buckets, heads, meta, payloads, downsampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY, SERIES, SERIES_COLUMNS, finite
from .slices import is_small, ranked


def time_window(series: DataFrame, start_ms: float | None = None, end_ms: float | None = None) -> DataFrame:
    """Rows in [start, end]; a bound may be missing. The filter reaches the Parquet scan."""
    if start_ms is not None:
        series = series.where(F.col("x_ms") >= F.lit(float(start_ms)))
    if end_ms is not None:
        series = series.where(F.col("x_ms") <= F.lit(float(end_ms)))
    return series


def select_channels(series: DataFrame, channels: list[str] | None = None, tests: list[int] | None = None) -> DataFrame:
    if channels is not None:
        series = series.where(F.col("channel_name").isin(list(channels)))
    if tests is not None:
        series = series.where(F.col("test_run_id").isin(list(tests)))
    return series


def bucket_average(series: DataFrame, bucket_ms: float) -> DataFrame:
    """Mean of each bucket, at the bucket's start; buckets are counted from epoch 0. Partial sums come before the shuffle."""
    start = F.floor(F.col("x_ms") / bucket_ms) * F.lit(float(bucket_ms))
    keys = ["test_run_id", "test_run_code", "channel_name", "unit"]
    return series.groupBy(*keys, start.alias("x_ms")).agg(F.avg("y").alias("y")).select(*SERIES_COLUMNS)


def head(series: DataFrame, k: int) -> DataFrame:
    """The first k rows of each series in time; Spark limits groups before the shuffle."""
    by = Window.partitionBy(*KEY).orderBy("x_ms", "y")
    return series.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).drop("_n")


def meta(series: DataFrame) -> DataFrame:
    """Count, extrema, first and last time and first unit of each series."""
    return series.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min("x_ms").alias("first_ms"), F.max("x_ms").alias("last_ms"), F.min_by("unit", "x_ms").alias("unit"),
    )


def counts(series: DataFrame) -> DataFrame:
    return series.groupBy(*KEY).agg(F.count("*").alias("n"))


def detail_hint(series: DataFrame, cap: int) -> DataFrame:
    """Whether any series reached the cap, and the time bounds of all: one row."""
    return counts_and_bounds(series).agg(
        (F.max("n") >= cap).alias("downsampled"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
    )


def counts_and_bounds(series: DataFrame) -> DataFrame:
    return series.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("x_ms").alias("first_ms"), F.max("x_ms").alias("last_ms"))


#: Points of a series in a payload, unless the viewport says how many.
PAYLOAD_POINTS = 10_000


def payload(series: DataFrame, points: int = PAYLOAD_POINTS) -> DataFrame:
    """A row for each series with its arrays x_ms and y in time order; longer series are reduced to `points`, which bounds the arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("x_ms", "y")))
    grouped = lttb(series, points).groupBy("test_run_id", "test_run_code", "channel_name", "unit").agg(ordered.alias("points"))
    return grouped.select("test_run_id", "test_run_code", "channel_name", "unit", F.col("points.x_ms").alias("x_ms"), F.col("points.y").alias("y"))


def from_start(series: DataFrame) -> DataFrame:
    """Times counted from each run's first sample. The minimum is aggregated apart and joined, so long runs are not sorted."""
    first = series.groupBy("test_run_id").agg(F.min("x_ms").alias("_t0"))
    return series.join(first, "test_run_id").withColumn("x_ms", F.col("x_ms") - F.col("_t0")).select(*SERIES_COLUMNS)


def decimate(series: DataFrame, hz: float) -> DataFrame:
    """The first sample of each 1/hz second of each series."""
    width = 1000.0 / hz
    first = F.min(F.struct("x_ms", "y", "test_run_code", "unit"))
    kept = series.groupBy(*KEY, F.floor(F.col("x_ms") / width).alias("_slot")).agg(first.alias("p"))
    return kept.select("test_run_id", "p.test_run_code", "channel_name", "p.unit", "p.x_ms", "p.y")


def by_index(series: DataFrame) -> DataFrame:
    """Times replaced by the number of the sample in its series, from 0."""
    return ranked(series, KEY, "x_ms", "y").withColumn("x_ms", F.col("_place").cast("double")).select(*SERIES_COLUMNS)


def renamed(series: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Channels by their aliases; channels without one keep their name."""
    if not aliases:
        return series
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return series.withColumn("channel_name", F.coalesce(F.try_element_at(known, F.col("channel_name")), F.col("channel_name")))


def only(series: DataFrame, channels: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """The channels of these names, then by their aliases."""
    return renamed(select_channels(series, channels), aliases or {})


#: What downsampling adds to the rows of a series: the place in it, the bucket (null where the series stays whole), and of the points that a
#: row stands for their number and the sums of places and values.
POINTS = f"{SERIES}, place double, slot long, weight double, places double, values double"


def _edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets begin in rows ordered by series and bucket, and which of them begin a series; a series that stays whole is one bucket."""
    codes = [table.column(c).combine_chunks().dictionary_encode().indices for c in KEY]
    run, channel = (pc.fill_null(c, -1).to_numpy(zero_copy_only=False) for c in codes)
    slot = pc.fill_null(table.column("slot"), -2).to_numpy()
    series = np.ones(len(slot), bool)
    series[1:] = (run[1:] != run[:-1]) | (channel[1:] != channel[:-1])
    bucket = series.copy()
    bucket[1:] |= slot[1:] != slot[:-1]
    at = np.flatnonzero(bucket)
    return at, series[at]


def on_hull(bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points, ordered by bucket and x, are corners of their bucket's convex hull.

    A point on or below the line between two others is no corner of the upper hull, whether they are or not, so all such points go at
    once, until every point left is above the line between its neighbours.
    """
    keep = np.zeros(len(x), bool)
    for sign in (1, -1):
        at = np.arange(len(x))
        while len(at) > 2:
            p, c, q = at[:-2], at[1:-1], at[2:]
            with np.errstate(over="ignore", invalid="ignore"):
                side = (x[c] - x[p]) * (y[q] - y[p]) - (y[c] - y[p]) * (x[q] - x[p])
            gone = (bucket[p] == bucket[q]) & (sign * side >= 0)
            if not gone.any():
                break
            at = np.delete(at, np.flatnonzero(gone) + 1)
        keep[at] = True
    return keep


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the corners of each bucket's hull, of what a batch has of the bucket; the first corner stands for all its points' sums."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        at, _ = _edges(table)
        bucket = np.repeat(np.arange(len(at)), np.diff([*at, len(table)]))
        keep = on_hull(bucket, table.column("place").to_numpy(), table.column("y").to_numpy()) | table.column("slot").is_null().to_numpy()
        own = table.select(table.column_names[:8])
        for name in table.column_names[8:]:
            sums = np.zeros(len(table))
            sums[at] = np.add.reduceat(table.column(name).to_numpy(), at)
            own = own.append_column(name, pa.array(sums))
        yield from own.filter(pa.array(keep)).combine_chunks().to_batches()


def _triangles(last_slot: int):
    """Picks a point of each bucket of rows ordered by series, bucket and place: the one that makes the largest triangle with the point picked
    before and the mean of the bucket behind. What is kept between batches are the rows of two buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, (0.0, 0.0)
        for batch in _ended(batches):
            parts = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None and len(t)]
            if not parts:
                continue
            table = pa.concat_tables(parts).combine_chunks()
            at, new = _edges(table)
            ends = [*at[1:].tolist(), len(table)]
            place, y, *sums = (table.column(c).to_numpy() for c in ("place", "y", "weight", "places", "values"))
            weight, places, values = (np.add.reduceat(c, at) for c in sums)
            slots = pc.fill_null(table.column("slot"), -2).to_numpy()[at].tolist()
            done = len(at) if batch is None else max(0, len(at) - 2)
            picked = []
            for k, a, z in zip(range(done), at.tolist(), ends, strict=False):
                if slots[k] == -2:
                    picked += range(a, z)
                    continue
                best = a
                if 0 <= slots[k] < last_slot:
                    nx, ny = places[k + 1] / weight[k + 1], values[k + 1] / weight[k + 1]
                    best += int(np.abs((before[0] - nx) * (y[a:z] - before[1]) - (before[0] - place[a:z]) * (ny - before[1])).argmax())
                before = place[best], y[best]
                picked.append(best)
            rest = table.slice(at[done]) if done < len(at) else None
            yield from table.select(SERIES_COLUMNS).take(pa.array(picked, pa.int64())).combine_chunks().to_batches()

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def lttb(series: DataFrame, points: int) -> DataFrame:
    """Largest-triangle-three-buckets: `points` of each series, chosen by position; shorter series stay whole.

    Positions are counted by slices. The area of a triangle grows linearly away from a line, so the point picked is a corner of its bucket's
    convex hull: tasks shrink what they have of a bucket to its hull, hulls of one bucket are merged by another task, and only the
    choice from bucket to bucket, which needs the point chosen before, goes through the corners of a series in order. Of equal areas the
    first place wins. A small input goes through in one pass, without hulls.
    """
    if points <= 0:
        return series
    points = max(points, 2)
    valid = series.where(finite(F.col("y"))).select(*SERIES_COLUMNS)
    rows = ranked(valid, KEY, "x_ms", "y")
    place, last = F.col("_place"), F.col("_n") - 1
    width = (F.col("_n") - 2) / F.lit(float(max(points - 2, 1)))
    guess = F.floor((place - 1) / width)
    # the bucket i holds places from floor(i * width) + 1 on; rounding may put the guess one off
    slot = F.when(F.floor((guess + 1) * width) + 1 <= place, guess + 1).when(F.floor(guess * width) + 1 > place, guess - 1).otherwise(guess)
    slot = F.when(place == 0, -1).when(place == last, points - 2).otherwise(F.least(slot, F.lit(points - 3)))
    slot = F.when(F.col("_n") > points, slot.cast("long"))
    middle = (F.col("_n") > points) & (place > 0) & (place < last)
    rows = rows.where(~middle) if points == 2 else rows  # only the ends have buckets
    rows = rows.select(*SERIES_COLUMNS, place.cast("double").alias("place"), slot.alias("slot"), F.lit(1.0).alias("weight"), place.cast("double").alias("places"), F.col("y").alias("values"))
    if is_small(valid):
        ordered = rows.sortWithinPartitions(*KEY, "place")  # the windows have put a series into one partition
    else:
        shrunk = rows.mapInArrow(_hulls, POINTS)  # ranking has left a slice's rows in order
        merged = shrunk.repartition(*KEY, "slot").sortWithinPartitions(*KEY, "slot", "place").mapInArrow(_hulls, POINTS)
        ordered = merged.repartition(*KEY).sortWithinPartitions(*KEY, "place")
    return ordered.mapInArrow(_triangles(points - 2), SERIES)
