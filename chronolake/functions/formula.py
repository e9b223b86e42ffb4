"""The formula language of calculated channels, compiled to columns.

A formula is parsed to Python's syntax tree, of which a small part is allowed, and never evaluated as text. Pure arithmetic
becomes one projection. Each stateful call (rolling windows, TRAPZ, BAND_PASS_FILTER, RISE, FALL, SETTLING) becomes a stage: its
argument is a column, its result another.

A row whose evaluation fails or is not finite is dropped. A stateful call takes a row into its state only if the row reaches it,
that is if nothing evaluated before it in the row failed.
"""

from __future__ import annotations

import ast
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rolling import trailing
from ..operators.slices import integral, seconds_before
from ..operators.steps import band_pass, settling_time, step_time
from ..plans.lod import reference
from ..schema import SERIES_COLUMNS, finite

MOST_CHANNELS = 26
#: Rolling functions and their reductions.
ROLLING = {
    "SMOOTH": "smooth", "ROLLING_MEAN": "mean", "ROLLING_SUM": "sum", "ROLLING_MIN": "min", "ROLLING_MAX": "max", "ROLLING_STD": "std_pop",
    "RMS": "rms", "PEAK": "peak",
}


class FormulaError(ValueError):
    def __init__(self, why: str):
        super().__init__(f"Invalid formula: {why}")


@dataclass(frozen=True)
class CalculatedChannel:
    """kind is rolling (op, window) or formula (formula over channels A, B, C, ...)."""

    name: str
    channels: list[str]
    kind: str = "formula"
    formula: str = ""
    op: str = "mean"
    window: int = 1
    unit: str | None = None


def parse(formula: str) -> ast.expr:
    text = formula.strip().removeprefix("=").strip().upper()
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(str(e)) from e


def _only(valid: Column, value: Column) -> Column:
    """value where it is defined, else null, which stands for a failed evaluation."""
    return F.when(valid, value)


def _not_infinite(c: Column) -> Column:
    return _only(~F.isnan(c) & (F.abs(c) < float("inf")), c)


_PLAIN = {
    "ABS": (1, 1, F.abs), "SIN": (1, 1, F.sin), "COS": (1, 1, F.cos), "TAN": (1, 1, F.tan), "ATAN": (1, 1, F.atan),
    "SQRT": (1, 1, lambda x: _only(x >= 0, F.sqrt(x))),
    "EXP": (1, 1, lambda x: _not_infinite(F.exp(x))),
    "LOG": (1, 2, lambda x, b=None: _only((x > 0) if b is None else (x > 0) & (b > 0) & (b != 1), F.log(x) if b is None else F.log(x) / F.log(b))),
    "LOG10": (1, 1, lambda x: _only(x > 0, F.log10(x))),
    "ASIN": (1, 1, lambda x: _only(F.abs(x) <= 1, F.asin(x))),
    "ACOS": (1, 1, lambda x: _only(F.abs(x) <= 1, F.acos(x))),
    "POW": (2, 2, lambda x, y: _not_infinite(F.pow(x, y))),
    "FLOOR": (1, 1, lambda x: F.floor(x).cast("double")),
    "CEIL": (1, 1, lambda x: F.ceil(x).cast("double")),
    "MIN": (2, 99, lambda *x: F.least(*x)),
    "MAX": (2, 99, lambda *x: F.greatest(*x)),
    "CLAMP": (3, 3, lambda x, lo, hi: F.least(F.greatest(x, lo), hi)),
}

_BINARY = {
    ast.Add: lambda x, y: x + y,
    ast.Sub: lambda x, y: x - y,
    ast.Mult: lambda x, y: x * y,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda x, y: _only(y != 0, F.floor(F.try_divide(x, y)).cast("double")),
    ast.Mod: lambda x, y: _only(y != 0, x - y * F.floor(F.try_divide(x, y))),  # the sign of the divisor
    ast.Pow: lambda x, y: _not_infinite(F.pow(x, y)),
}
_COMPARE = {
    ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y, ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y,
    ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y,
}


class _Compiler:
    def __init__(self, df: DataFrame, variables: dict[str, str], by: list[str]):
        self.df, self.variables, self.by = df, variables, by
        self.reached: list[Column] = []  # of what was evaluated so far, that it did not fail
        self.stages = 0

    def column(self, node: ast.expr) -> Column:
        c = self._column(node)
        self.reached.append(c.isNotNull())
        return c

    def _column(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return F.col(self.variables[node.id]) if node.id in self.variables else F.lit(None).cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x = self.column(node.operand)
            return -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            x, y = self.column(node.left), self.column(node.right)
            return _BINARY[type(node.op)](x, y)
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            parts = [self.column(x) for x in (node.left, *node.comparators)]
            return reduce(lambda a, b: a & b, (_COMPARE[type(o)](x, y) for o, x, y in zip(node.ops, parts, parts[1:], strict=False))).cast("double")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return self._call(node.func.id, node.args)
        raise FormulaError(f"{type(node).__name__} is not allowed")

    def _call(self, name: str, args: list[ast.expr]) -> Column:
        nothing = F.lit(None).cast("double")
        if name == "ROUND":
            if not 1 <= len(args) <= 2:
                return nothing
            return F.bround(self.column(args[0]), int(_number(args[1])) if len(args) == 2 else 0)  # half to even
        if name in _PLAIN:
            least, most, function = _PLAIN[name]
            columns = [self.column(a) for a in args]
            return function(*columns) if least <= len(columns) <= most else nothing
        if name in ROLLING and 1 <= len(args) <= 2:
            return self._rolling(name, args)
        if name == "TRAPZ" and len(args) == 1:
            return self._integral(args[0])
        if name == "BAND_PASS_FILTER" and len(args) == 3:
            low, high = _number(args[1]), _number(args[2])
            self._timed()
            return self._staged(args[0], lambda df, x, out: band_pass(df, f"{x}_in", "_dt", out, self.by, low, high))
        if name in ("RISE", "FALL") and 1 <= len(args) <= 3:
            levels = dict(zip(("lo", "hi"), map(_number, args[1:]), strict=False))
            return self._staged(args[0], lambda df, x, out: step_time(df, x, out, [*self.by, f"{x}_ok"], falling=name == "FALL", **levels))
        if name == "SETTLING" and 1 <= len(args) <= 3:
            own = dict(zip(("band", "hold_s"), map(_number, args[1:]), strict=False))
            return self._staged(args[0], lambda df, x, out: settling_time(df, x, out, [*self.by, f"{x}_ok"], **own))
        for a in args:
            self.column(a)
        return nothing

    def _argument(self, node: ast.expr) -> str:
        """The argument as a column of the frame, and whether the row enters the state as another; names without clashes."""
        x = self.column(node)
        self.stages += 1
        name = f"_arg{self.stages}"
        ok = reduce(lambda a, b: a & b, self.reached) & finite(x)
        self.df = self.df.withColumns({name: x, f"{name}_ok": F.coalesce(ok, F.lit(False))})
        return name

    def _rolling(self, name: str, args: list[ast.expr]) -> Column:
        width = int(_number(args[1])) if len(args) == 2 else 1
        x = self._argument(args[0])
        self.df = trailing(self.df, F.col(x), ROLLING[name], width, f"{x}_out", [*self.by, f"{x}_ok"])
        return F.when(F.col(f"{x}_ok"), F.col(f"{x}_out"))

    def _integral(self, node: ast.expr) -> Column:
        x = self._argument(node)
        self._timed()
        self.df = integral(self.df, self.by, x, f"{x}_ok", "_dt", f"{x}_out")
        return F.when(F.col(x).isNotNull(), F.col(f"{x}_out"))

    def _timed(self) -> None:
        """Gives the rows the seconds since the row before, where a call needs them."""
        if "_dt" not in self.df.columns:
            self.df = seconds_before(self.df, self.by, "_dt")

    def _staged(self, node: ast.expr, stage) -> Column:
        x = self._argument(node)
        ok = F.col(f"{x}_ok")
        self.df = self.df.withColumn(f"{x}_in", F.when(ok, F.col(x)))
        self.df = stage(self.df, x, f"{x}_out")
        return F.when(ok, F.col(f"{x}_out"))


def _number(node: ast.expr) -> float:
    """A literal argument: window lengths, levels and frequencies are part of the plan."""
    sign = 1.0
    while isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        sign, node = (-sign if isinstance(node.op, ast.USub) else sign), node.operand
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and math.isfinite(node.value):
        return sign * float(node.value)
    raise FormulaError("window lengths, levels and frequencies must be numbers")


def align(series: DataFrame, channels: list[str], per_test: bool = True) -> DataFrame:
    """A row for each time at which all channels have a finite value, with columns v0, v1, ...

    Times are equal to the microsecond. Of several values of a channel at a time the greatest counts. Without per_test, times of
    all runs meet, and the rows carry the least run.
    """
    names = [reference(c) for c in channels]
    key = ["test_run_id"] if per_test else []
    own = series.where(F.col("channel_name").isin(names)).withColumn("_us", F.round(F.col("x_ms") * 1000).cast("long"))
    values = [F.max(F.when(F.col("channel_name") == n, F.col("y"))).alias(f"v{i}") for i, n in enumerate(names)]
    first = [] if per_test else [F.min("test_run_id").alias("test_run_id")]
    # by code first: an aggregate of strings makes every task sort all rows that it reads
    coded = own.groupBy(*key, "_us", "test_run_code").agg(*first, F.min("x_ms").alias("x_ms"), *values)
    rows = coded.groupBy(*key, "_us").agg(*first, F.min("test_run_code").alias("test_run_code"), F.min("x_ms").alias("x_ms"), *[F.max(f"v{i}").alias(f"v{i}") for i in range(len(names))])
    return rows.where(reduce(lambda a, b: a & b, (finite(F.col(f"v{i}")) for i in range(len(names)))))


def every_sample(series: DataFrame, channel: str) -> DataFrame:
    """A row for each finite sample of a channel, as of align(); samples of one time are numbered by value in _nth, which is their order."""
    own = series.where((F.col("channel_name") == reference(channel)) & finite(F.col("y")))
    nth = F.row_number().over(Window.partitionBy("test_run_id", "x_ms").orderBy("y"))
    return own.select("test_run_id", "test_run_code", "x_ms", F.col("y").alias("v0"), nth.alias("_nth"))


def evaluate(aligned: DataFrame, formula: str, n_channels: int, by: list[str]) -> DataFrame:
    """aligned rows with the formula's value as y; rows that fail are dropped."""
    if n_channels > MOST_CHANNELS:
        raise FormulaError(f"more than {MOST_CHANNELS} channels")
    compiler = _Compiler(aligned, {chr(ord("A") + i): f"v{i}" for i in range(n_channels)}, by)
    value = compiler.column(parse(formula))
    return compiler.df.withColumn("y", value.cast("double")).where(finite(F.col("y")))


def formula_channel(series: DataFrame, spec: CalculatedChannel, per_test: bool = True, merge_times: bool = True) -> DataFrame:
    """The series of a calculated channel. Samples of one time are one; without merge_times, which a formula of one channel can do without, each
    is a sample of its own."""
    if not spec.channels or not re.search(r"\S", spec.formula):
        return series.limit(0)
    if not merge_times and len(spec.channels) > 1:
        raise FormulaError("samples of several channels meet by their times")
    rows = align(series, spec.channels, per_test) if merge_times else every_sample(series, spec.channels[0])
    by = ["test_run_id"]
    if not per_test:
        rows, by = rows.withColumn("_all", F.lit(0)), ["_all"]
    out = evaluate(rows, spec.formula, len(spec.channels), by)
    return out.withColumns({"channel_name": F.lit(spec.name), "unit": F.lit(spec.unit).cast("string")}).select(*SERIES_COLUMNS)


def mask_by_formula(series: DataFrame, channels: list[str], formula: str, keep_missing: bool = False) -> DataFrame:
    """Samples at times of their run at which the formula of the channels is not zero; with keep_missing also those of times it has no value for."""
    rows = evaluate(align(series, channels), formula, len(channels), ["test_run_id"])
    marks = rows.select("test_run_id", F.round(F.col("x_ms") * 1000).cast("long").alias("_us"), (F.col("y") != 0).alias("_on"))
    met = series.withColumn("_us", F.round(F.col("x_ms") * 1000).cast("long")).join(marks, ["test_run_id", "_us"], "left")
    return met.where(F.coalesce(F.col("_on"), F.lit(keep_missing))).select(*SERIES_COLUMNS)
