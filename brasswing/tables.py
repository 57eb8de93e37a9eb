"""Relational tables at their boundary types.

Money columns arrive as DOUBLE and dates as timestamps; queries see
DECIMAL(16,2) and DATE. The casts are projections right above the scan, so
column pruning and date predicates still reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(16,2)"

#: Column casts at the boundary, by table.
BOUNDARY: dict[str, dict[str, str]] = {
    "region": {},
    "nation": {},
    "customer": {"c_acctbal": MONEY},
    "supplier": {"s_acctbal": MONEY},
    "part": {"p_retailprice": MONEY},
    "orders": {"o_totalprice": MONEY, "o_orderdate": "date"},
    "lineitem": {
        "l_quantity": MONEY,
        "l_extendedprice": MONEY,
        "l_discount": MONEY,
        "l_tax": MONEY,
        "l_shipdate": "date",
    },
    "events": {},
}

#: Composite and single primary keys: declared, never enforced.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
}


def load(spark: SparkSession, sf_dir: str, name: str, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Table ``name`` under ``sf_dir`` with its boundary casts.

    ``bounds`` gives money columns a range (low, high) that a later filter implies.
    It is widened by a cent and put on the raw column, where the Parquet reader can
    skip row groups; the cast column would keep it from doing so.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, (low, high) in (bounds or {}).items():
        if low is not None:
            df = df.filter(F.col(column) >= low - 0.01)
        if high is not None:
            df = df.filter(F.col(column) <= high + 0.01)
    casts = BOUNDARY.get(name, {})
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """(Re)define temporary views for ``names``, all relational tables by default."""
    for name in names or tuple(BOUNDARY):
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def oracle_view(name: str) -> str:
    """The boundary casts as a sub-select for a SQL oracle on the raw files."""
    casts = BOUNDARY[name]
    if not casts:
        return name
    replaced = ", ".join(f"CAST({c} AS {t.upper()}) AS {c}" for c, t in casts.items())
    return f"(SELECT * REPLACE ({replaced}) FROM {name})"
