"""Unit conversion: formulas over x compiled to columns, and one CASE for a library of categories."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """A preferred unit and the formulas over x that lead to it from other units."""

    name: str
    preferred: str
    units: dict[str, str] = field(default_factory=dict)


#: The library that stands where none is given.
TEMPERATURE = Category("Temperature", "K", {"C": "x + 273", "F": "(x - 32) * 5/9 + 273"})


def _walk(node: ast.expr, x, constant):
    if isinstance(node, ast.Expression):
        return _walk(node.body, x, constant)
    if isinstance(node, ast.Name) and node.id.lower() == "x":
        return x
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return constant(float(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        inner = _walk(node.operand, x, constant)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
        a, b = _walk(node.left, x, constant), _walk(node.right, x, constant)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        return a * b if isinstance(node.op, ast.Mult) else (F.try_divide(a, b) if isinstance(a, Column) or isinstance(b, Column) else a / b)
    raise ValueError("a unit formula has x, numbers, + - * / and parentheses only")


def check(formula: str) -> None:
    """Fails on formulas that are not allowed or can't be evaluated at 0, 1 and 100."""
    try:
        tree = ast.parse(formula.strip(), mode="eval")
        for x in (0.0, 1.0, 100.0):
            _walk(tree, x, float)
    except (SyntaxError, ZeroDivisionError) as e:
        raise ValueError(f"unit formula {formula!r}: {e}") from e


def to_column(formula: str, x: Column) -> Column:
    check(formula)
    return _walk(ast.parse(formula.strip(), mode="eval"), x, lambda v: F.lit(v))


def _cases(categories: list[Category]):
    seen: set[str] = set()
    for c in categories:
        for symbol, formula in c.units.items():
            key = symbol.strip().lower()
            if key and key not in seen and key != c.preferred.strip().lower():
                seen.add(key)
                yield key, formula, c.preferred


def preferred_value(y: Column, unit: Column, categories: list[Category]) -> Column:
    """y in its category's preferred unit; unknown and preferred units leave it as it is. The first category that fits counts."""
    key, out = F.lower(F.trim(unit)), None
    for symbol, formula, _ in _cases(categories):
        converted = to_column(formula, y)
        out = F.when(key == symbol, converted) if out is None else out.when(key == symbol, converted)
    return y if out is None else out.otherwise(y)


def preferred_unit(unit: Column, categories: list[Category]) -> Column:
    key, out = F.lower(F.trim(unit)), None
    for symbol, _, preferred in _cases(categories):
        out = F.when(key == symbol, F.lit(preferred)) if out is None else out.when(key == symbol, F.lit(preferred))
    return unit if out is None else out.otherwise(unit)
