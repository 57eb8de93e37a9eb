"""Aggregation: scalar, grouped, partitioned, and the truncating average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row for the whole input; SUM, AVG, MIN and MAX of nothing are NULL, COUNT is 0."""
    return df.agg(*aggregates)


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """GROUP BY with map-side partial aggregation. Without aggregates: the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates)


def partitioned(df: DataFrame, keys: Sequence[str], *aggregates: Column, partitions: int | None = None) -> DataFrame:
    """GROUP BY over rows partitioned by key first: for so many groups that partial sums do not shrink them."""
    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return spread.groupBy(*keys).agg(*aggregates)


def avg_trunc(column: str, scale: int = 2) -> Column:
    """Average truncated toward zero, in units of 10^-scale (BIGINT); NULL for no values."""
    units = F.sum((F.col(column) * 10**scale).cast("decimal(30,0)"))
    return F.call_function("div", units, F.count(column)).cast("bigint")


def sum_of(expression: Column, precision: int, scale: int) -> Column:
    """SUM at a stated decimal type."""
    return F.sum(expression).cast(f"decimal({precision},{scale})")


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Arithmetic over two aggregates, rounded; NULL when the denominator is 0."""
    return F.round(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), digits)
