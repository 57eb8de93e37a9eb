"""Column statistics: row count, distinct counts, equi-depth and singleton histograms.

Every figure covers all rows. Histograms have a fixed number of bins, so what
reaches the driver does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegerType, LongType, StringType

BINS = 256
#: Strings with at most so many distinct values get one count per value.
SINGLETON_LIMIT = 64


def column_stats(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_distinct): exact row counts, HyperLogLog++ distinct counts, in one pass."""
    wanted = [F.count(F.lit(1)).alias("n")] + [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*wanted)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(df.columns)]
    return one.select(F.col("n").alias("n_rows"), F.explode(F.array(*pairs)).alias("s")).select(
        "s.column", "n_rows", "s.n_distinct"
    )


def _quantiles(df: DataFrame, column: str, bins: int):
    """(n, q): number of values and approximate quantiles of a column, dates as days."""
    value = F.unix_date(column) if isinstance(df.schema[column].dataType, DateType) else F.col(column)
    quantiles = F.percentile_approx(value.cast("double"), [i / bins for i in range(bins + 1)], 10 * bins)
    return F.struct(F.count(column).alias("n"), quantiles.alias("q"))


def _bins(row, bins: int) -> list[tuple[float, float, float]]:
    if not row["n"]:
        return []
    return [(row["q"][i], row["q"][i + 1], row["n"] / bins) for i in range(bins)]


def equi_depth(df: DataFrame, column: str, bins: int = BINS) -> list[tuple[float, float, float]]:
    """Bins (low, high, rows) of about equal depth from approximate quantiles."""
    return _bins(df.agg(_quantiles(df, column, bins).alias("s")).first()["s"], bins)


def singletons(df: DataFrame, columns: list[str], limit: int = SINGLETON_LIMIT) -> dict[str, dict | None]:
    """Per column, value to count, or None beyond ``limit`` distinct values; one pass over the table for all columns."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]))
    counts = df.select(cells.alias("c")).filter("c.v IS NOT NULL").groupBy("c.i", "c.v").count()
    # At most limit + 1 counts a column reach the driver.
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("v"))).filter(F.col("r") <= limit + 1)
    out: dict[str, dict | None] = {c: {} for c in columns}
    for row in ranked.collect():
        if (held := out[columns[row["i"]]]) is not None:
            held[row["v"]] = row["count"]
    return {c: None if len(v) > limit else v for c, v in out.items()}


def singleton(df: DataFrame, column: str, limit: int = SINGLETON_LIMIT) -> dict | None:
    """Value to count, or None beyond ``limit`` distinct values."""
    return singletons(df, [column], limit)[column]


def analyse(df: DataFrame, bins: int = BINS) -> dict:
    """All statistics of one table as a JSON-ready dictionary: one pass for counts and quantiles, one for counts by value."""
    wanted = [F.count(F.lit(1)).alias("n")]
    for i, field in enumerate(df.schema.fields):
        wanted.append(F.approx_count_distinct(field.name).alias(f"d{i}"))
        if isinstance(field.dataType, IntegerType | LongType | DecimalType | DateType):
            wanted.append(_quantiles(df, field.name, bins).alias(f"q{i}"))
    row = df.agg(*wanted).first()
    out: dict = {"n_rows": row["n"], "columns": {}}
    listed = []
    for i, field in enumerate(df.schema.fields):
        entry: dict = {"n_distinct": row[f"d{i}"]}
        if f"q{i}" in row:
            entry["equi_depth"] = _bins(row[f"q{i}"], bins)
        elif isinstance(field.dataType, BooleanType) or (isinstance(field.dataType, StringType) and row[f"d{i}"] <= SINGLETON_LIMIT):
            listed.append(field.name)
        out["columns"][field.name] = entry
    for name, found in singletons(df, listed).items():
        out["columns"][name]["singleton"] = found
    return out


def selectivity(stats: dict, column: str, operator: str, value: float | str, high: float | None = None) -> float:
    """Estimated share of rows for ``column operator value``, from histogram, else distinct count, else 0.5."""
    entry, n = stats["columns"].get(column, {}), stats["n_rows"]
    if not n:
        return 0.0
    if operator in ("<>", "!="):
        return 1.0 - selectivity(stats, column, "=", value)
    if (single := entry.get("singleton")) is not None:
        hit = {
            "=": lambda k: k == str(value),
            "<": lambda k: k < str(value),
            "<=": lambda k: k <= str(value),
            ">": lambda k: k > str(value),
            ">=": lambda k: k >= str(value),
            "between": lambda k: str(value) <= k <= str(high),
        }[operator]
        return min(1.0, sum(c for k, c in single.items() if hit(k)) / n)
    if operator == "=":
        return 1.0 / max(1, entry.get("n_distinct", 2))
    if bins := entry.get("equi_depth"):

        def below(x: float) -> float:
            total = 0.0
            for low, top, depth in bins:
                if x >= top:
                    total += depth
                elif x > low:
                    total += depth * (x - low) / (top - low)
            return min(1.0, total / n)

        if operator in ("<", "<="):
            return below(float(value))
        if operator in (">", ">="):
            return 1.0 - below(float(value))
        if operator == "between":
            return max(0.0, below(float(high)) - below(float(value)))
    return 0.5


def either(*shares: float) -> float:
    """OR of independent estimates, never above 1."""
    return min(1.0, sum(shares))
