import pytest

from chronolake.functions.formula import CalculatedChannel
from chronolake.plans import lod


@pytest.mark.parametrize(
    "args, cap",
    [((600,), 1200), ((700,), 1400), ((700, None, None, "detail"), 2800), ((600, "auto", 1234), 1234), ((10,), 500), ((600, "raw"), None), ((600, None, None, "raw"), None), ((None,), None), ((10**9,), 5_000_000)],
)
def test_points_cap(args, cap):
    assert lod.points_cap(*args) == cap


@pytest.mark.parametrize("args, name", [(("overview", "auto", 10), "aggregate"), (("detail", "auto", 10), "raw_lttb"), (("raw", "auto", 10), "raw"), (("overview", "NONE ", 10), "raw"), (("overview", None, None), "raw")])
def test_strategy(args, name):
    assert lod.strategy(*args) == name


@pytest.mark.parametrize("span, cap, width", [(100, 100, 1.0), (10, 10_000, 0.001), (0, 5, 0.001), (1e9, 1, 86_400.0)])
def test_bucket_seconds(span, cap, width):
    assert lod.bucket_seconds(span, cap) == width


def test_window_and_times():
    assert lod.epoch_ms("2024-01-01T00:00:00Z") == lod.epoch_ms("2024-01-01T00:00:00") == lod.epoch_ms("2024-01-01T01:00:00+01:00") == 1704067200000
    assert lod.window_ms(["2024-01-01T00:00:00Z"]) == (1704067200000, None)
    assert lod.window_ms(None) == (None, None)


def test_dependency_order():
    a, b, c = CalculatedChannel("A1", ["raw"]), CalculatedChannel("B1", ["A1"]), CalculatedChannel("C1", ["x|B1", "A1"])
    assert [s.name for s in lod.dependency_order([c, b, a])] == ["A1", "B1", "C1"]
    x, y = CalculatedChannel("X", ["Y"]), CalculatedChannel("Y", ["X"])
    assert [s.name for s in lod.dependency_order([x, y, a])] == ["A1", "X", "Y"]
