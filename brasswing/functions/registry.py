"""Scalar functions by name, with typed inputs and a return type.

A function is SQL text over its arguments, or else a builder from Columns to a
Column; either way it stays inside generated code. A vectorised Python function
can be registered as a builder where no expression exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    name: str
    inputs: tuple[str, ...]
    returns: str
    sql: Callable[..., str] | None = None
    build: Callable[..., Column] | None = None
    compute_bound: bool = False


class Registry:
    """Name to function; unknown names and wrong arities fail when planning."""

    def __init__(self) -> None:
        self._known: dict[str, Function] = {}

    def register(self, function: Function) -> None:
        self._known[function.name.lower()] = function

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, name: str) -> Function | None:
        return self._known.get(name.lower())

    def call(self, name: str, *arguments: Column | str) -> Column:
        function = self._known.get(name.lower())
        if function is None:
            raise ValueError(f"unknown function: {name}")
        if len(arguments) != len(function.inputs):
            raise ValueError(f"{name} takes {len(function.inputs)} arguments, got {len(arguments)}")
        typed = [
            (F.col(a) if isinstance(a, str) else a).cast(t) for a, t in zip(arguments, function.inputs, strict=True)
        ]
        if function.build is None:
            return F.call_function(function.name, *typed)
        return function.build(*typed).cast(function.returns)

    def install(self, spark: SparkSession) -> Registry:
        """Make every function with SQL text callable by name, in SQL and through ``call``; others only through ``call``."""
        for f in self._known.values():
            if f.sql is None:
                continue
            names = [f"a{i}" for i in range(len(f.inputs))]
            signature = ", ".join(f"{n} {t}" for n, t in zip(names, f.inputs, strict=True))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({signature}) RETURNS {f.returns} RETURN {f.sql(*names)}")
        return self


def _steps(a: str, b: str) -> str:
    """The sample function, on cents. Fifteen steps: add b, and once more when the step or the value so far is a multiple of five."""
    return (
        f"CAST(aggregate(sequence(0, 14), CAST({a} * 100 AS BIGINT), (r, i) -> "
        f"r + CAST({b} * 100 AS BIGINT) * IF(i % 5 = 0 OR r % 5 = 0, 2, 1)) AS DECIMAL(38,0)) / 100"
    )


TEST = Function("test", ("decimal(16,2)", "decimal(16,2)"), "decimal(16,2)", sql=_steps, compute_bound=True)


def default_registry() -> Registry:
    registry = Registry()
    registry.register(TEST)
    return registry
