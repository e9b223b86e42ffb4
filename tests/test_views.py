"""Views over events and cursors against plain loops, on runs in one piece and in slices."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronolake.operators import slices, views
from chronolake.schema import SERIES


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    rows = []
    for run in (1, 2):
        for channel in "AB":
            at = rnd.uniform(0, 50)
            for _ in range(120):
                at += rnd.choice([0, 1, 3, 7.5, 60]) * 10.0
                rows.append((run, "r", channel, "u", at, rnd.choice([None, float("nan"), 1.0, 2.5, 4.0, 9.0, -3.0])))
    return rows


@pytest.fixture(params=["whole", "sliced"])
def runs(spark, data, request, monkeypatch):
    if request.param == "sliced":
        monkeypatch.setattr(slices, "SMALL_BYTES", -1)
        monkeypatch.setattr(slices, "SLICE_ROWS", 25)
    return spark.createDataFrame(data, SERIES).repartition(4)


def points(data, run, channel):
    return sorted((x, y) for r, _, c, _, x, y in data if (r, c) == (run, channel) and y is not None and not math.isnan(y))


def line(own, x, gap=math.inf):
    """The last sample of a time counts where it is met, the first where the line goes to it."""
    before, after = [p for p in own if p[0] <= x], [p for p in own if p[0] > x]
    if not before:
        return None
    if before[-1][0] == x:
        return before[-1][1]
    if not after or after[0][0] - before[-1][0] > gap:
        return None
    (x0, y0), (x1, y1) = before[-1], after[0]
    return y0 + (y1 - y0) * ((x - x0) / (x1 - x0))


def test_cursors(spark, data, runs):
    times = [(k, run, float(t)) for run in (1, 2, 3) for k, t in enumerate([-5, 0, 100, 333.3, 1000, points(data, 1, "A")[7][0], 99_999])]
    got = {(r.cursor_id, r.test_run_id, r.channel_name): r for r in views.cursor_values(runs, spark.createDataFrame(times, "cursor_id long, test_run_id long, at_ms double")).collect()}
    assert len(got) == 7 * 4
    for (k, run, channel), r in got.items():
        want = line(points(data, run, channel), r.at_ms)
        assert r.y == want or r.y == pytest.approx(want)
        own = sorted((c for c in times if c[1] == run), key=lambda c: (c[2], c[0]))
        place = [c[0] for c in own].index(k)
        if place:
            assert r.delta_ms == pytest.approx(r.at_ms - own[place - 1][2])
            last = line(points(data, run, channel), own[place - 1][2])
            assert r.delta_y is None if None in (want, last) else r.delta_y == pytest.approx(want - last)


def test_residual_and_grid(spark, data, runs):
    got = sorted((r.test_run_id, r.x_ms, r.residual) for r in views.residual(runs, "A", "B", 700.0).collect())
    want = sorted((run, x, y - b) for run in (1, 2) for x, y in points(data, run, "A") if (b := line(points(data, run, "B"), x, 700.0)) is not None)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want]) and len(got) > 50
    got = {(r.test_run_id, r.channel_name, r.x_ms): r.y for r in views.resampled(runs, 25.0, 100.0).collect()}
    want = {}
    for run in (1, 2):
        for c in "AB":
            own = points(data, run, c)
            for k in range(math.ceil(own[0][0] / 25), math.floor(own[-1][0] / 25) + 1):
                if (y := line(own, 25.0 * k, 100.0)) is not None:
                    want[run, c, 25.0 * k] = y
    assert got == pytest.approx(want)
    assert views.residual(runs.limit(0), "A", "B").count() == 0 and views.resampled(runs.limit(0), 10.0).count() == 0


def test_envelope(spark, data):
    series = spark.createDataFrame(data, SERIES).repartition(3)
    events = [(k, run, float(t)) for k, (run, t) in enumerate([(1, 100), (1, 130), (1, 130), (2, 700), (9, 5)])] + [(8, 1, None)]
    got = {(r.channel_name, r.bin_ms): r for r in views.event_envelope(series, spark.createDataFrame(events, "event_id long, test_run_id long, at_ms double"), 100.0, 300.0, 50.0, (0.25, 0.75)).collect()}
    bins = defaultdict(list)
    for k, run, t in events:
        for c in "AB":
            for x, y in points(data, run, c):
                if t is not None and -100 <= x - t <= 300:
                    bins[c, math.floor((x - t) / 50) * 50.0].append((y, k))
    assert got.keys() == bins.keys()
    for key, own in bins.items():
        ys, r = sorted(y for y, _ in own), got[key]
        rank = lambda p: ys[max(0, math.ceil(p * len(ys)) - 1)]  # noqa: B023, E731
        assert (r.n, r.n_events, r.min_y, r.max_y) == (len(ys), len({k for _, k in own}), ys[0], ys[-1]) and r.mean_y == pytest.approx(sum(ys) / len(ys))
        assert (r.low_y, r.high_y) == (rank(0.25), rank(0.75))
    with pytest.raises(ValueError):
        views.event_envelope(series, spark.createDataFrame(events, "event_id long, test_run_id long, at_ms double"), 0.0, 0.0, 1.0)


def test_density(spark, data):
    series = spark.createDataFrame(data, SERIES)
    got = {(r.channel_name, r.time_bin, r.value_bin): (r.n, r.n_runs) for r in views.density(series, 5, 4).collect()}
    want = defaultdict(list)
    for c in "AB":
        own = [(run, x, y) for run in (1, 2) for x, y in points(data, run, c)]
        (x0, x1), (y0, y1) = [[f(p[k] for p in own) for f in (min, max)] for k in (1, 2)]
        for run, x, y in own:
            want[c, min(4, int((x - x0) / (x1 - x0) * 5)), min(3, int((y - y0) / (y1 - y0) * 4))].append(run)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert views.density(series.limit(0), 5, 4).count() == 0
    one = views.density(series.where("test_run_id = 1").withColumn("y", F.lit(2.0)), 1, 3).collect()
    assert {(r.channel_name, r.time_bin, r.value_bin, r.n) for r in one} == {("A", 0, 0, 120), ("B", 0, 0, 120)}
    assert sum(r.n for r in views.density(series, 3, 4, even=False).collect()) == sum(len(points(data, r, c)) for r in (1, 2) for c in "AB")


def test_quantiles_are_exact_for_many_values(spark, monkeypatch):
    """More values of a group than any sketch keeps, whole and in slices; ranks are whole numbers also where 0.1 * n is not exact."""
    n = 60_070
    rows = spark.range(n).select(F.lit("A").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("y"), F.lit(3).cast("long").alias("n"))
    rows = rows.union(spark.range(70).select(F.lit("B"), F.col("id").cast("double"), F.lit(1).cast("long")))
    shares = [Fraction(1, 10), Fraction(1, 4), Fraction(1, 3), Fraction(9, 10)]
    want = {k: [float(math.ceil(s * m) - 1) for s in shares] for k, m in (("A", n), ("B", 70))}
    for small in (slices.SMALL_BYTES, -1):
        monkeypatch.setattr(slices, "SMALL_BYTES", small)
        monkeypatch.setattr(slices, "SLICE_ROWS", 5_000)
        assert {r.k: r.quantiles for r in views.quantiles(rows, ["k"], shares).collect()} == want


def test_views_of_many_values_have_exact_quantiles(spark):
    """Bins of values that come out even, and percentiles of an envelope, over 80,000 different values."""
    n = 80_000
    series = spark.range(n).select(
        F.lit(1).cast("long").alias("test_run_id"), F.lit("r").alias("test_run_code"), F.lit("A").alias("channel_name"), F.lit("u").alias("unit"),
        F.col("id").cast("double").alias("x_ms"), (F.col("id") * 7919 % n).cast("double").alias("y"),
    )
    cells = {r.value_bin: r.n for r in views.density(series, 1, 4, even=False).collect()}
    assert cells == {0: n // 4, 1: n // 4, 2: n // 4, 3: n // 4}
    events = spark.createDataFrame([(1, 1, 0.0)], "event_id long, test_run_id long, at_ms double")
    (row,) = views.event_envelope(series, events, 1.0, float(n), 2.0 * n, (0.1, 0.9)).collect()
    assert (row.n, row.low_y, row.high_y) == (n, n // 10 - 1.0, n * 9 // 10 - 1.0)
