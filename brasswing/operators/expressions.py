"""Scalar expressions whose dialect meaning differs from Spark's default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """``/`` on integers: quotient truncated toward zero; division by zero raises under ANSI."""
    return F.call_function("div", a, b)


def dec_div(a: Column, b: Column, scale: int = 8) -> Column:
    """Decimal quotient at a fixed scale, so that results compare across engines."""
    return (a / b).cast(f"decimal(38,{scale})")


def case(branches: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Searched CASE; without ELSE the value is NULL."""
    if not branches:
        raise ValueError("CASE needs at least one WHEN")
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def like(column: Column, pattern: str) -> Column:
    """LIKE; prefix, suffix and infix patterns become the cheaper string predicates."""
    if not pattern:
        raise ValueError("empty LIKE pattern")
    body = pattern.strip("%")
    if body and "%" not in body and "_" not in body:
        head, tail = pattern.endswith("%"), pattern.startswith("%")
        if pattern == "%" * tail + body + "%" * head:
            if head and tail:
                return column.contains(body)
            if head:
                return column.startswith(body)
            if tail:
                return column.endswith(body)
            return column == body
    return column.like(pattern)


def add_interval(date: Column, amount: int, unit: str) -> Column:
    """DATE plus or minus whole years, months or days; month ends are clamped."""
    unit = unit.upper()
    if unit == "DAY":
        return F.date_add(date, amount)
    if unit == "MONTH":
        return F.add_months(date, amount)
    if unit == "YEAR":
        return F.add_months(date, 12 * amount)
    raise ValueError(f"unknown interval unit: {unit}")
