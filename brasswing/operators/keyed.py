"""Keyed tables: insert-if-absent, lookup and update as set operations on DataFrames.

A keyed table is a DataFrame of (key, value) with unique, non-null keys. Batches
may repeat keys: the row with the lowest ``seq`` wins an insert, the highest an update;
without a ``seq`` column the smallest value wins an insert and the largest an update.
Rows with a null key are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _one_per_key(batch: DataFrame, last: bool) -> DataFrame:
    rank = F.col("seq") if "seq" in batch.columns else F.col("value")
    pick = F.max_by("value", rank) if last else F.min_by("value", rank)
    return batch.filter(F.col("key").isNotNull()).groupBy("key").agg(pick.alias("value"))


def insert(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Add keys that are absent; a key that exists keeps its value."""
    new = _one_per_key(batch, last=False)
    return table.select("key", "value").unionByName(new.join(table.select("key"), "key", "left_anti"))


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per requested key: (key, value, found)."""
    hit = table.select("key", "value", F.lit(True).alias("__hit"))
    return (
        keys.select("key")
        .join(hit, "key", "left")
        .select("key", "value", F.coalesce("__hit", F.lit(False)).alias("found"))
    )


def update(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Overwrite keys that exist; others in the batch change nothing (see ``missing``)."""
    new = _one_per_key(batch, last=True).select("key", F.col("value").alias("__new"), F.lit(True).alias("__hit"))
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value"))
    return table.select("key", "value").join(new, "key", "left").select("key", value.alias("value"))


def missing(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys of an update batch that the table does not hold."""
    return batch.select("key").distinct().join(table.select("key"), "key", "left_anti")


def parse_workload(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``INSERT|READ|UPDATE <key>`` as (op, key, seq); any other line raises on use."""
    lines = spark.read.text(path).select(
        F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("seq")
    )
    op = F.upper(F.col("p")[0])
    known = F.when(op.isin("INSERT", "READ", "UPDATE"), op).otherwise(F.raise_error(F.lit("unknown operation")))
    return lines.filter(F.size("p") > 1).select(known.alias("op"), F.col("p")[1].cast("bigint").alias("key"), "seq")


def replay(table: DataFrame, workload: DataFrame, value: str = "key") -> tuple[DataFrame, DataFrame]:
    """Apply the operations of one phase in the order of ``seq``. Returns (table, reads).

    An INSERT of a held key and an UPDATE of an absent one change nothing. ``reads`` has
    (seq, key, value, found) per READ, as of its place in the order. Keys are
    independent, so the order is kept within each key, over rows sorted by it.
    """
    held = table.select("key", F.lit(None).cast("bigint").alias("seq"), F.lit("INSERT").alias("op"), F.col("value"))
    asked = workload.filter("key IS NOT NULL").select("key", "seq", "op", F.col(value).cast(table.schema["value"].dataType).alias("value"))
    # Rows of the table come first: their seq is null.
    order = Window.partitionBy("key").orderBy(F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce(F.sum((F.col("op") == "INSERT").cast("int")).over(order), F.lit(0))
    rows = held.unionByName(asked).withColumn("inserts", first)
    writes = ((F.col("op") == "INSERT") & (F.col("inserts") == 1)) | ((F.col("op") == "UPDATE") & (F.col("inserts") > 0))
    now = F.last(F.when(writes, F.struct("value")), ignorenulls=True).over(order)
    rows = rows.withColumn("now", now)
    reads = rows.filter("op = 'READ'").select("seq", "key", F.col("now.value").alias("value"), F.col("now").isNotNull().alias("found"))
    last = F.max_by("now", F.coalesce("seq", F.lit(-(2**63))))
    after = rows.groupBy("key").agg(last.alias("now")).filter("now IS NOT NULL").select("key", F.col("now.value").alias("value"))
    return after, reads


def replay_phases(table: DataFrame, phases: Sequence[DataFrame], value: str = "key") -> tuple[DataFrame, list[DataFrame]]:
    """Apply phases (fill, then mixed) one after the other. Returns (table, reads of each phase)."""
    reads = []
    for phase in phases:
        table, found = replay(table, phase, value)
        reads.append(found)
    return table, reads
