import random

import pytest

from chronolake.operators import ranges
from chronolake.schema import SERIES


def frame(spark, values, run=1, channel="T", step=200.0):
    return spark.createDataFrame([(run, "r", channel, "u", k * step, None if v is None else float(v)) for k, v in enumerate(values)], SERIES)


def spans(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def test_pulse(spark):
    df = frame(spark, [1, 1, 50, 55, 2, 1])
    assert spans(ranges.threshold_ranges(df, ">", 10)) == [(400.0, 600.0)]
    assert spans(ranges.threshold_ranges(df, ">", 10, 201)) == []
    assert spans(ranges.threshold_ranges(df, "between", (1.5, 52))) == [(400.0, 400.0), (800.0, 800.0)]
    with pytest.raises(ValueError):
        ranges.threshold_ranges(df, "~", 1)


def test_edges(spark):
    df = frame(spark, [1, 2, 3, 1], step=1000.0)
    assert spans(ranges.edge_ranges(df, 1.5)) == [(1000.0, 1001.0)]
    assert spans(ranges.detect(df, {"kind": "edge", "config": {"threshold": 1.5, "direction": "falling", "window_ms": 5}})) == [(3000.0, 3005.0)]
    assert spans(ranges.detect(df, {"kind": "threshold", "config": '{"op": "<", "value": 1.5}'})) == [(0.0, 0.0), (3000.0, 3000.0)]
    assert spans(ranges.detect(df, {"kind": "Formula", "config": {"expr": "min"}})) == [(0.0, 1.0)]
    for wrong in ({"kind": "edge", "config": {"threshold": 1, "direction": "up"}}, {"kind": "threshold", "config": {"op": "=", "value": 1}}, {"kind": "x"},
                  {"kind": "formula", "config": {"expr": "mean"}}, {"kind": "threshold", "config": "[1]"}, {"kind": "threshold", "config": "{"}):
        with pytest.raises(ValueError):
            ranges.detect(df, wrong)


def test_extrema_take_the_first(spark):
    df = frame(spark, [3, 9, 9, None, 0, 0])
    assert spans(ranges.extremum_ranges(df, True, 100)) == [(150.0, 250.0)]
    assert spans(ranges.extremum_ranges(df, False)) == [(800.0, 801.0)]


def _ranges(spark, rows):
    return spark.createDataFrame(rows, "range_id long, test_run_id long, parent_range_id long, start_ms double, end_ms double, source string")


def test_tree(spark):
    df = _ranges(spark, [(1, 1, None, 0.0, 10.0, "source"), (2, 1, None, 1.0, 5.0, "user"), (3, 1, 2, 1.0, 2.0, "user"), (4, 1, None, 8.0, 12.0, "user")])
    got = {r.range_id: r.parent_range_id for r in ranges.adopt(df, df.where("source = 'source'")).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: None}
    left = {r.range_id: r.parent_range_id for r in ranges.delete_range(df, 2).collect()}
    assert left == {1: None, 3: 1, 4: None}
    assert ranges.delete_range(df, 1).count() == 4


def test_pair_and_mask_against_loops(spark):
    rnd = random.Random(1)
    starts = [(1, "A", float(t), t + 2.0) for t in sorted(rnd.sample(range(200), 25))]
    ends = [(1, "B", float(t), t + 3.0) for t in sorted(rnd.sample(range(200), 20))]
    schema = "test_run_id long, channel_name string, start_ms double, end_ms double"
    a, b = spark.createDataFrame(starts, schema), spark.createDataFrame(ends, schema)
    for last in (False, True):
        want = sorted((s, (max if last else min)(e for *_, e in ends if e > s)) for _, _, s, _ in starts if any(e > s for *_, e in ends))
        assert spans(ranges.pair(a, b, last)) == want
    series = frame(spark, range(220), step=1.0)
    inside = lambda x: any(s <= x <= e for *_, s, e in starts)
    assert sorted(r.x_ms for r in ranges.mask(series, a).collect()) == [float(x) for x in range(220) if inside(x)]
    assert sorted(r.x_ms for r in ranges.mask(series, a, inside=False).collect()) == [float(x) for x in range(220) if not inside(x)]


def test_summary_status(spark):
    df = frame(spark, [1, 5, 9], step=1000.0)
    r = spark.createDataFrame([(7, 1, 0.0, 1000.0), (8, 1, 0.0, 2000.0), (9, 1, 5.0, 1.0)], "range_id long, test_run_id long, start_ms double, end_ms double")
    got = {x.range_id: (x.n, x.mean_y, x.status) for x in ranges.summary(df, r, high=8.0, warn=4.0).collect()}
    assert got == {7: (2, 3.0, "warn"), 8: (3, 5.0, "fail")}


def test_summary_of_ranges_of_any_length(spark):
    """A range over all time is no more rows than a short one; ranges of one run may differ in length by any factor."""
    df = frame(spark, range(60), step=60_000.0)
    spans = [(1, 1, -1e15, 1e15), (2, 1, 60_000.0, 60_000.0), (3, 1, 0.0, 3_540_000.0), (4, 1, 65_536.0, 131_072.0), (5, 1, 30_000.0, 200_000.0), (6, 2, 0.0, 1e15)]
    r = spark.createDataFrame(spans, "range_id long, test_run_id long, start_ms double, end_ms double")
    got = {x.range_id: (x.n, x.min_y, x.max_y) for x in ranges.summary(df, r).collect()}
    assert got == {1: (60, 0.0, 59.0), 2: (1, 1.0, 1.0), 3: (60, 0.0, 59.0), 4: (1, 2.0, 2.0), 5: (3, 1.0, 3.0)}


def test_names(spark):
    df = ranges.named(ranges.threshold_ranges(frame(spark, [0, 5, 0, 5]), ">", 1), "burn")
    assert sorted(r.name for r in df.collect()) == ["burn 1", "burn 2"]


def test_stretches_over_days_against_loops(spark):
    """Stretches and crossings that pass from day to day, over days without samples, and by equal times."""
    rnd = random.Random(7)
    rows, t = [], 0.0
    for k in range(400):
        t += rnd.choice([0.0, 3_600_000.0, 20 * 3_600_000.0, 90 * 3_600_000.0])
        rows.append((1, "r", "T", "u", t, None if rnd.random() < 0.05 else float(rnd.choice([0, 9, 9, 9]))))
    df = spark.createDataFrame(rows, SERIES).repartition(5)
    seen = sorted((x, y) for *_, x, y in rows if y is not None)
    want, start, last = [], None, None
    for x, y in seen:
        if y > 5:
            start, last = x if start is None else start, x
        elif start is not None:
            want.append((start, last))
            start = None
    if start is not None:
        want.append((start, last))
    assert spans(ranges.threshold_ranges(df, ">", 5)) == want and len(want) > 20
    assert spans(ranges.edge_ranges(df, 5.0)) == [(x, x + 1) for (_, a), (x, y) in zip(seen, seen[1:]) if a < 5 <= y]
    assert ranges.threshold_ranges(df.limit(0), ">", 5).count() == 0
