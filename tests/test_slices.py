"""Runs cut into slices give what uncut runs give, and are not one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.functions.formula import CalculatedChannel, formula_channel
from chronolake.operators import series as ops
from chronolake.operators import ranges, slices, spectral
from chronolake.operators.rolling import rolling_channel
from chronolake.schema import SERIES

from .test_series import triangles


@pytest.fixture(scope="module")
def runs(spark):
    """Two long runs with gaps, nulls and values that are not finite, a short one, and one without an id."""
    rnd = random.Random(17)
    rows = []
    for run, n in ((1, 400), (2, 90), (3, 2), (None, 60)):
        for channel in "AB":
            at = 0.0
            for k in range(n):
                at += rnd.choice([1, 1, 1, 7, 500]) * 1000.0
                y = rnd.choice([None, float("nan")]) if rnd.random() < 0.05 else rnd.choice([0, 5, 10, 30, 60, 90, 95, 100]) + (k > n / 2) * 3.0
                rows.append((run, f"r{run}", channel, "u", at, y))
    return spark.createDataFrame(rows, SERIES).repartition(5).cache()


@pytest.fixture
def small_slices(monkeypatch):
    def on(rows=16):
        monkeypatch.setattr(slices, "SMALL_BYTES", -1)
        monkeypatch.setattr(slices, "SLICE_ROWS", rows)

    return on


def rows_of(df):
    return sorted(((r.test_run_id, r.channel_name, r.x_ms, None if r.y is None else round(r.y, 6)) for r in df.collect()), key=str)


FORMULAS = [
    "ROLLING_STD(A, 40)", "PEAK(SQRT(A - 20), 3)", "TRAPZ(SQRT(A - 20)) + 0 * A", "BAND_PASS_FILTER(A, 0.0001, 0.01)", "RISE(A)", "FALL(A, 4, 200)", "FALL(SQRT(A - 1))",
    "SETTLING(A, 0.3, 2)", "SETTLING(A, 60, 600)",
]


@pytest.mark.parametrize("text", FORMULAS)
def test_formulas(spark, runs, small_slices, text):
    spec = CalculatedChannel("out", ["A"], formula=text)
    own = runs.where("test_run_id is not null")
    want = rows_of(formula_channel(own, spec))
    small_slices()
    got = formula_channel(own, spec)
    assert rows_of(got) == want and len(want) > 300


@pytest.mark.parametrize("op, width", [("mean", 3), ("sum", 40)])
def test_rolling(spark, runs, small_slices, op, width):
    want = rows_of(rolling_channel(runs, "A", op, width, "m"))
    small_slices()
    got = rolling_channel(runs, "A", op, width, "m")
    assert rows_of(got) == want and any(r[0] is None for r in want)
    assert "_block" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("points", [2, 12, 50])
def test_lttb(spark, runs, small_slices, points):
    want = {}
    for r in sorted(runs.where("y is not null and not isnan(y)").collect(), key=lambda r: (r.x_ms, r.y)):
        want.setdefault((r.test_run_id, r.channel_name), []).append((r.x_ms, r.y))
    want = {k: [v[i] for i in sorted(set(triangles([y for _, y in v], points)))] for k, v in want.items()}
    for k in range(2):
        if k:
            small_slices(30)
        got = {}
        for r in ops.lttb(runs, points).collect():
            got.setdefault((r.test_run_id, r.channel_name), []).append((r.x_ms, r.y))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_stretches_and_edges(spark, runs, small_slices):
    own = runs.where("test_run_id is not null")
    found = lambda: (sorted(map(str, ranges.threshold_ranges(own, ">", 40).collect())), sorted(map(str, ranges.edge_ranges(own, 50.0, False).collect())))
    want = found()
    small_slices(12)
    assert found() == want and min(map(len, want)) > 30


def test_numbers_and_spectra(spark, runs, small_slices):
    own = runs.where("y is not null and not isnan(y)")
    want, power = rows_of(ops.by_index(own)), sorted(map(str, spectral.power_density(own.where("test_run_id = 1"), 16).collect()))
    small_slices(20)
    assert rows_of(ops.by_index(own)) == want
    assert sorted(map(str, spectral.power_density(own.where("test_run_id = 1"), 16).collect())) == power


def test_hulls_keep_what_lies_farthest():
    rng = np.random.default_rng(1)
    for y in (rng.normal(size=400), np.zeros(50), np.arange(30.0), np.arange(40.0) ** 2, rng.integers(0, 3, 200).astype(float), np.array([1.0]), np.array([2.0, 1.0])):
        x = np.arange(len(y), dtype=float)
        keep = slices_hull(x, y)
        for _ in range(20):
            a, b = rng.normal(size=2)
            far = np.abs(a * x + b * y)
            assert math.isclose(far.max(), far[keep].max(), rel_tol=1e-12)
    assert ops.on_hull(np.zeros(5000, int), np.arange(5000.0), rng.normal(size=5000)).sum() < 60


def slices_hull(x, y):
    two = ops.on_hull(np.repeat([0, 1], len(x)), np.concatenate([x, x]), np.concatenate([y, -y]))
    keep = ops.on_hull(np.zeros(len(x), int), x, y)
    assert (two[: len(x)] == keep).all() and two[len(x) :].sum() == keep.sum()
    return keep


def test_a_long_run_is_many_tasks(spark, small_slices):
    """No task sorts or transforms more than a slice of a run."""
    rows = spark.range(20_000).selectExpr("1L AS test_run_id", "'r' AS test_run_code", "'A' AS channel_name", "'u' AS unit", "id * 10.0D AS x_ms", "sin(id / 50) AS y").repartition(4)
    small_slices(1000)
    c = slices.cut(rows, ["test_run_id"])
    sizes = [r["count"] for r in c.df.groupBy("_slice").count().collect()]
    assert c.sliced and len(sizes) >= 20 and max(sizes) <= 1100
    assert ops.lttb(rows, 100).count() == 100
    assert slices.is_small(rows) is False


@pytest.mark.parametrize("sliced", [False, True])
def test_band_pass_steps_at_every_sample_of_a_time(spark, small_slices, sliced):
    """Samples of one time, equal ones too, are each a step of the filter, in the order of their values."""
    rnd = random.Random(3)
    rows, at = [], 0.0
    for _ in range(60):
        at += rnd.choice([1000.0, 40_000.0])
        rows += [(1, "r", "A", "u", at, y) for y in [rnd.uniform(0, 9)] * rnd.choice([1, 4]) + [rnd.uniform(0, 9)] * rnd.choice([0, 3])]
    series = spark.createDataFrame(rows, SERIES).repartition(3)
    want, states, before = [], None, None
    for _, _, _, _, x, y in sorted(rows, key=lambda r: (r[4], r[5])):
        dt = max(0.0 if before is None else (x - before) / 1000, 1e-6)
        states = [y, y] if before is None else [s + dt / (1 / (2 * math.pi * hz) + dt) * (y - s) for s, hz in zip(states, (0.01, 0.0001), strict=True)]
        before = x
        want.append((x, states[0] - states[1]))
    if sliced:
        small_slices()
    spec = CalculatedChannel("out", ["A"], formula="BAND_PASS_FILTER(A, 0.0001, 0.01)")
    got = sorted((r.x_ms, r.y) for r in formula_channel(series, spec, merge_times=False).collect())
    assert [x for x, _ in got] == [x for x, _ in sorted(want)] and [y for _, y in got] == pytest.approx([y for _, y in sorted(want)], abs=1e-9)
    assert formula_channel(series, spec).count() == 60


def test_slices_are_sorted_by_tasks_of_their_own(spark, runs, small_slices):
    """Ranking deals slices over so many partitions that few share one, and adaptive execution does not merge them."""
    small_slices()
    out = slices.ranked(runs, ["test_run_id", "channel_name"], "x_ms", "y")
    held = out.groupBy(F.spark_partition_id().alias("part")).count().collect()
    n = runs.count()
    assert sum(r["count"] for r in held) == n and len(held) > n / slices.SLICE_ROWS / 2 and max(r["count"] for r in held) < n / 4
