"""Result sinks: rows, JSON, text table, and none."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from statistics import median

from pyspark.sql import DataFrame, Row


def rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, so the driver holds one partition."""
    return df.toLocalIterator(prefetchPartitions=True)


def to_json(df: DataFrame) -> Iterator[str]:
    """One JSON document per row."""
    return (r[0] for r in df.selectExpr("to_json(struct(*)) AS j").toLocalIterator())


def to_text(df: DataFrame, n: int = 20) -> str:
    """The first ``n`` rows as a text table (a report: bounded by design)."""
    return df._show_string(n, False, False)


def discard(df: DataFrame) -> None:
    """Run the plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def benchmark(query: Callable[[], DataFrame], iterations: int = 3, output: str | None = None) -> dict:
    """Run a query ``iterations`` times into the empty sink; optionally write the summary as JSON."""
    seconds = []
    for _ in range(iterations):
        began = time.perf_counter()
        discard(query())
        seconds.append(round(time.perf_counter() - began, 4))
    summary = {"iterations": iterations, "seconds": seconds, "median": median(seconds), "min": min(seconds)}
    if output:
        with open(output, "w") as file:
            json.dump(summary, file)
    return summary
