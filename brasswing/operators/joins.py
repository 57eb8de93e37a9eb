"""Join strategies. All are inner equi-joins unless the name says otherwise.

The physical strategy is left to Catalyst and AQE; a hint is given only where
the caller asks for one. A side is broadcast only after its size is checked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest plan-estimated size of a side that is sent to every executor. Estimates of scans are
#: sizes of compressed files; rows in memory take several times that, so the bound is low.
BROADCAST_LIMIT = 16 << 20
#: Left rows of one key from which on a salted join deals them out.
HOT_ROWS = 1_000_000
#: Pairs of rows with equal keys that a task of a blocked join compares; a few seconds of one core.
TASK_PAIRS = 1 << 24
#: Blocks of a task. They are dealt by hash: with one a task, the fullest of a thousand tasks gets six or more.
TASK_BLOCKS = 16
#: Most tasks that a blocked join asks for. Beyond it tasks take more blocks each.
MOST_TASKS = 1 << 16

Keys = str | Sequence[str | tuple[str, str]]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``, from compressed file sizes; filters do not lower it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast when its estimate is within ``limit``; otherwise leave it to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def _condition(left: DataFrame, right: DataFrame, on: Keys) -> Column:
    pairs = [on] if isinstance(on, str) else list(on)
    terms = [left[k] == right[k] if isinstance(k, str) else left[k[0]] == right[k[1]] for k in pairs]
    out = terms[0]
    for term in terms[1:]:
        out = out & term
    return out


def equi_join(left: DataFrame, right: DataFrame, on: Keys, residual: Column | None = None) -> DataFrame:
    """``JOIN .. ON`` over one or several equalities, with an optional residual theta condition.

    NULL keys match nothing. Both key columns stay in the result, as in SQL.
    """
    condition = _condition(left, right, on)
    return left.join(right, condition if residual is None else condition & residual, "inner")


def blocked_join(left: DataFrame, right: DataFrame, on: tuple[str, str], residual: Column, pairs: int = TASK_PAIRS) -> DataFrame:
    """Equi-join with a residual where few keys hold many rows of both sides, so that pairs far outnumber rows.

    Such inputs are small in bytes, by which Spark sizes its tasks, while the pairs of a key grow
    with the product of its rows. Rows are counted by key first. Up to ``pairs`` in all, this is a
    plain join. Beyond, there are as many tasks as the total holds ``pairs``, a number that AQE
    leaves alone, and a key with more pairs than a block is cut into blocks of about ``side`` rows
    of each table, ``side`` being the square root of ``pairs / TASK_BLOCKS``. Each row has one block
    of its own side and is repeated for the blocks of the other, so each pair meets once. At most
    |left| + |right| + 2 |pairs of cut keys| / ``side`` rows are shuffled, behind a first deal
    of the tables themselves where one split would make too many copies; tasks hold the rows of one
    block. Cut keys are no more than blocks, so they are sent to every executor.

    Rows are dealt by a hash of all their columns, so a task that is run again deals them alike;
    identical rows stay together. Both key columns must have one type.
    """
    left_key, right_key = on
    per_left = left.groupBy(F.col(left_key).alias("__key")).agg(F.count(F.lit(1)).cast("double").alias("__l"))
    per_right = right.groupBy(F.col(right_key).alias("__key_r")).agg(F.count(F.lit(1)).cast("double").alias("__r"))
    keys = per_left.join(per_right, F.col("__key") == F.col("__key_r")).withColumn("__n", F.col("__l") * F.col("__r"))
    total = keys.agg(F.sum("__n")).first()[0] or 0
    if total <= pairs:
        return equi_join(left, right, [on], residual)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(total / pairs)))
    side = math.sqrt(pairs / TASK_BLOCKS)
    # About total / side copies are made of each table; a task makes side * side of them.
    writers = min(MOST_TASKS, math.ceil(total / side**3))
    blocks = lambda n: F.ceil(F.col(n) / side).cast("int")
    hot = keys.filter(F.col("__n") > side * side).select(F.col("__key").alias("__hot"), blocks("__l").alias("__of_left"), blocks("__r").alias("__of_right"))

    def dealt(table: DataFrame, key: str, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*[table[n] for n in table.columns])
        spread = table.repartition(writers, *table.columns) if writers > 1 else table
        out = spread.join(F.broadcast(hot), spread[key] == hot["__hot"], "left")
        out = out.withColumn(f"__{own}", F.pmod(row, F.coalesce(f"__of_{own}", F.lit(1))).cast("int"))
        out = out.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__of_{other}", F.lit(1)) - 1)))
        return out.drop("__hot", "__of_left", "__of_right").repartition(tasks, key, "__left", "__right")

    a = dealt(left, left_key, "left", "right").withColumnsRenamed({"__left": "__a_left", "__right": "__a_right"})
    b = dealt(right, right_key, "right", "left").withColumnsRenamed({"__left": "__b_left", "__right": "__b_right"})
    joined = equi_join(a, b.hint("merge"), [on, ("__a_left", "__b_left"), ("__a_right", "__b_right")], residual)
    return joined.drop("__a_left", "__a_right", "__b_left", "__b_right")


def broadcast_join(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """Global hash table on ``right`` when it is small enough, a shuffled join otherwise."""
    return equi_join(left, broadcast_if_small(right), on)


def partitioned_hash_join(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """Partition both sides by key and build one hash table per partition of ``right``."""
    return equi_join(left, right.hint("shuffle_hash"), on)


def filtered_hash_join(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """Partitioned join behind a semi-join reduction of ``left``, for a selective ``right``.

    The distinct keys of ``right`` reduce ``left`` before its wide rows are moved:
    by broadcast when the keys are few, else through Spark's runtime Bloom filter.
    """
    names = [on] if isinstance(on, str) else list(on)
    pairs = [(k, k) if isinstance(k, str) else k for k in names]
    keys = right.select(*[F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(pairs)]).distinct()
    if estimated_bytes(keys) <= BROADCAST_LIMIT:
        condition = F.lit(True)
        for i, (name, _) in enumerate(pairs):
            condition = condition & (left[name] == keys[f"__k{i}"])
        left = left.join(F.broadcast(keys), condition, "left_semi")
    return partitioned_hash_join(left, right, on)


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join on any condition. Without an equality this is a nested loop: meant for small ``right``."""
    return left.join(broadcast_if_small(right), condition, "inner")


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; the caller owns the size of the result."""
    return left.crossJoin(right)


def exists(left: DataFrame, right: DataFrame, on: Keys, residual: Column | None = None) -> DataFrame:
    """``WHERE EXISTS (...)``: a semi-join, so rows of ``left`` are never repeated."""
    condition = _condition(left, right, on)
    return left.join(right, condition if residual is None else condition & residual, "left_semi")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join for a ``left`` in which a few keys hold a large share of the rows.

    Keys with more than ``hot_rows`` left rows are counted first. Only their rows are
    spread over ``salts`` partitions, and only their rows of ``right`` are repeated
    once a salt; all other rows have salt 0. There are at most |left| / ``hot_rows`` hot
    keys, a hundred thousand in 10^11 rows, so they are sent to every executor.
    """
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > hot_rows) & F.col(key).isNotNull())
    hot = F.broadcast(hot.select(F.col(key).alias("__hot")))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    spread = left.join(hot, left[key] == hot["__hot"], "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(F.lit(0))).drop("__hot")
    renamed = right.withColumnRenamed(key, "__key")
    copies = renamed.join(hot, renamed["__key"] == hot["__hot"], "left")
    each = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = copies.withColumn("__salt_r", F.explode(each)).drop("__hot")
    joined = spread.join(copies, (spread[key] == copies["__key"]) & (spread["__salt"] == copies["__salt_r"]))
    return joined.drop("__salt", "__salt_r", "__key")
