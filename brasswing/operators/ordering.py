"""ORDER BY, LIMIT/OFFSET and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _terms(order: Sequence[str]) -> list[Column]:
    out = []
    for term in order:
        name, _, direction = term.partition(" ")
        out.append(F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc())
    return out


def order_by(df: DataFrame, *order: str) -> DataFrame:
    """Total order by range partitioning; terms are ``"col"`` or ``"col desc"``."""
    return df.orderBy(*_terms(order))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """LIMIT n OFFSET m; which rows is undefined unless the input is ordered."""
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, k: int, *order: str, offset: int = 0) -> DataFrame:
    """ORDER BY + LIMIT as one bounded heap per partition (TakeOrderedAndProject)."""
    return limit(order_by(df, *order), k, offset)
