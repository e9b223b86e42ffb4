"""The series query: request, plan, execution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import CalculatedChannel, formula_channel
from ..operators import series as ops
from ..operators.rolling import rolling_channel
from .lod import MOST_CAP, bucket_seconds, dependency_order, points_cap, reference, strategy, window_ms


@dataclass(frozen=True)
class SeriesRequest:
    tests: list[int] | None = None
    channels: list[str] | None = None
    time_range: list[str | None] | None = None
    mode: str = "overview"
    aggregation: str = "auto"
    resolution_px: int | None = None
    max_points: int | None = None
    limit: int | None = None
    calculated: list[CalculatedChannel] = field(default_factory=list)
    #: Whether calculated channels see reduced series, as viewers do, or all samples.
    calc_stage: str = "reduced"


def calculate(base: DataFrame, specs: list[CalculatedChannel]) -> DataFrame:
    """base with its calculated channels; later ones see earlier ones."""
    for spec in dependency_order(specs):
        made = rolling_channel(base, reference(spec.channels[0]), spec.op, spec.window, spec.name, spec.unit) if spec.kind == "rolling" else formula_channel(base, spec)
        base = base.unionByName(made)
    return base


def reduce_series(rows: DataFrame, plan: str, cap: int | None, span_s: float | None = None, limit: int | None = None) -> DataFrame:
    if plan == "aggregate":
        if span_s is None:
            low, high = rows.agg(F.min("x_ms"), F.max("x_ms")).first()
            span_s = ((high or 0) - (low or 0)) / 1000
        return ops.bucket_average(rows, bucket_seconds(span_s, cap) * 1000)
    if plan == "raw_lttb":
        return ops.lttb(rows, cap)
    return ops.head(rows, max(1, min(limit, MOST_CAP))) if limit else rows


def run(series: DataFrame, request: SeriesRequest) -> tuple[DataFrame, dict]:
    """(series, plan) for a request over a lake or any other series. Nothing is collected but the span, when it isn't given."""
    start, end = window_ms(request.time_range)
    cap = points_cap(request.resolution_px, request.aggregation, request.max_points, request.mode)
    plan = strategy(request.mode, request.aggregation, cap)
    derived = {c.name for c in request.calculated}
    wanted = None
    if request.channels is not None:
        needed = {reference(c) for s in request.calculated for c in s.channels} - derived
        wanted = sorted({reference(c) for c in request.channels} | needed)
    rows = ops.time_window(ops.select_channels(series, wanted, request.tests), start, end)
    span = (end - start) / 1000 if start is not None and end is not None else None
    if request.calculated and request.calc_stage == "raw":
        out = reduce_series(calculate(rows, request.calculated), plan, cap, span, request.limit)
    else:
        out = reduce_series(rows, plan, cap, span, request.limit)
        out = calculate(out, request.calculated) if request.calculated else out
    return out, {"strategy": plan, "cap": cap, "start_ms": start, "end_ms": end}
