import math
import random

import pytest

from chronolake.functions.formula import CalculatedChannel, FormulaError, formula_channel, parse
from chronolake.operators.rolling import rolling_channel
from chronolake.schema import SERIES


def frame(spark, channels, run=1, step=1000.0):
    rows = [(run, f"r{run}", name, "u", 1000 * k * step / 1000, float(v) if v is not None else None) for name, values in channels.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, SERIES)


def values(spark, channels, text, **kw):
    out = formula_channel(frame(spark, channels), CalculatedChannel("out", list(channels), formula=text), **kw)
    return {int(r.x_ms // 1000): r.y for r in out.collect()}


STEP = [0, 0, 0, 80, 110, 95, 100, 100, 100]


@pytest.mark.parametrize(
    "channels, text, expected",
    [
        ({"A": range(5)}, "SMOOTH(A,3)", {0: 0.0, 1: 0.5, 2: 1.0, 4: 3.0}),
        ({"A": [1, 3], "B": [2, 4]}, "A + B", {0: 3.0, 1: 7.0}),
        ({"A": range(4)}, "TRAPZ(A)", {0: 0.0, 1: 0.5, 2: 2.0, 3: 4.5}),
        ({"A": [0, 0, 0, 10, 50, 90, 100, 100, 100]}, "RISE(A)", {4: 0.0, 5: 2.0, 8: 2.0}),
        ({"A": [0, 0, 10, 50, 90, 100]}, "RISE(A,10,90)", {4: 2.0}),
        ({"A": [100, 100, 90, 50, 10, 0, 0]}, "FALL(A)", {4: 2.0, 6: 2.0}),
        ({"A": STEP}, "SETTLING(A)", {5: 0.0, 6: 3.0, 8: 3.0}),
        ({"A": [0, 0, 80, 100, 100, 100]}, "SETTLING(A,0.02,1)", {3: 0.0, 4: 2.0}),
        ({"A": [2.5, 3.5]}, "ROUND(A)", {0: 2.0, 1: 4.0}),
        ({"A": [-7, 7]}, "A % 3 + A // 3", {0: 2.0 - 3.0, 1: 1.0 + 2.0}),
        ({"A": [-1, 4, 9]}, "SMOOTH(SQRT(A),3)", {1: 2.0, 2: 2.5}),
        ({"A": [0, 2]}, "1 / A", {1: 0.5}),
        ({"A": [1, 5]}, "(A > 2) * 10 + (1 <= A < 3)", {0: 1.0, 1: 10.0}),
        ({"A": [3, -4, 1]}, "PEAK(A, 2)", {0: 3.0, 1: 4.0, 2: 4.0}),
        ({"A": [1, 2, 3]}, "RISE(SMOOTH(A,2))", {0: 0.0}),
        ({"A": [1, 2]}, "NOPE(A)", {}),
        ({"A": [1, 2]}, "MIN(A)", {}),
    ],
)
def test_values(spark, channels, text, expected):
    got = values(spark, channels, text)
    assert expected.items() <= {k: round(v, 9) for k, v in got.items()}.items()
    if not expected:
        assert not got


def test_missing_inputs_drop_rows(spark):
    assert values(spark, {"A": [1, None, 3], "B": [1, 2, float("nan")]}, "A + B") == {0: 2.0}


def test_failures_before_a_call_take_no_slot(spark):
    assert values(spark, {"A": [4, -1, 4], "B": [1, 100, 3]}, "SQRT(A) * 0 + SMOOTH(B, 2)") == {0: 1.0, 2: 2.0}
    assert values(spark, {"A": [4, -1, 4], "B": [1, 100, 3]}, "SMOOTH(B, 2) + SQRT(A) * 0") == {0: 1.0, 2: 51.5}


@pytest.mark.parametrize("text", ["A +", "A.b", "__import__('os')", "[A]", "lambda: 1", "SMOOTH(A, B)"])
def test_invalid(spark, text):
    with pytest.raises(FormulaError):
        formula_channel(frame(spark, {"A": [1], "B": [1]}), CalculatedChannel("x", ["A", "B"], formula=text)).collect()


def test_runs_do_not_mix(spark):
    two = frame(spark, {"A": [1, 2, 3]}).union(frame(spark, {"A": [10, 20, 30]}, run=2))
    got = {(r.test_run_id, r.x_ms): r.y for r in formula_channel(two, CalculatedChannel("x", ["A"], formula="ROLLING_SUM(A,2)")).collect()}
    assert got[1, 2000.0] == 5.0 and got[2, 2000.0] == 50.0
    both = formula_channel(frame(spark, {"A": [1, 2]}).union(frame(spark, {"B": [5, 6]}, run=2)), CalculatedChannel("x", ["A", "B"], formula="A*B"), per_test=False)
    assert sorted(r.y for r in both.collect()) == [5.0, 12.0]


def test_rolling_channel(spark):
    out = rolling_channel(frame(spark, {"A": [1, 2, 3, float("inf"), None]}), "A", "mean", 2, "m").collect()
    assert sorted((r.x_ms, r.y) for r in out)[:3] == [(0.0, 1.0), (1000.0, 1.5), (2000.0, 2.5)]
    assert all(math.isfinite(r.y) and r.channel_name == "m" for r in out)
    std = rolling_channel(frame(spark, {"A": [1, 2, 4]}), "A", "std", 2, "s").collect()
    assert len(std) == 2  # a single sample has no sample deviation


def _machine(xs, ts, start, stop):
    """Seconds from reaching `start` to reaching `stop`, read row by row."""
    out, begun, held, was = [], None, 0.0, False
    for x, t in zip(xs, ts):
        now = start(x)
        if begun is None:
            begun = t if now and not was else None
        elif stop(x):
            held, begun = t - begun, None
        elif not now:
            begun = None
        was = now
        out.append(held)
    return out


def test_steps_against_a_machine(spark):
    rnd = random.Random(3)
    xs = [rnd.choice([0, 5, 10, 15, 30, 60, 85, 90, 95, 100]) for _ in range(400)]
    ts = list(range(400))
    low, high = min(xs) + 0.1 * (max(xs) - min(xs)), min(xs) + 0.9 * (max(xs) - min(xs))
    rise, fall = values(spark, {"A": xs}, "RISE(A)"), values(spark, {"A": xs}, "FALL(A)")
    assert [rise[t] for t in ts] == _machine(xs, ts, lambda x: x >= low, lambda x: x >= high)
    assert [fall[t] for t in ts] == _machine(xs, ts, lambda x: x <= high, lambda x: x <= low)


def test_band_pass(spark):
    got = values(spark, {"A": [1.0, 2.0, 0.5]}, "BAND_PASS_FILTER(A, 0.1, 0.4)")
    tau = lambda f: 1 / (2 * math.pi * f)
    lo = hi = 1.0
    for k, x in enumerate([1.0, 2.0, 0.5]):
        dt = 1.0 if k else 1e-6
        hi += dt / (tau(0.4) + dt) * (x - hi)
        lo += dt / (tau(0.1) + dt) * (x - lo)
        assert got[k] == pytest.approx(hi - lo, abs=1e-12)
    assert values(spark, {"A": [1, 2]}, "BAND_PASS_FILTER(A, 5, 1)") == {0: 1.0, 1: 2.0}


def test_parse_prefix():
    assert type(parse(" = a + 1")).__name__ == "BinOp"
