"""Hash partitioning of (key, payload) relations, with its check sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TUPLE = r"^(-?\d+)\D(-?\d+)"


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of two integers with one separating character: (key, payload). Other lines are skipped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(_TUPLE))
    return lines.select(*[F.regexp_extract("value", _TUPLE, i + 1).cast("bigint").alias(name) for i, name in enumerate(("key", "payload"))])


def radix_partition(df: DataFrame, key: str = "key", bits: int = 10) -> DataFrame:
    """Label each row with one of 2^bits partitions by the hash of its key, and deal rows by label.

    A partition stays together in one task; how many partitions a task takes is
    left to the runtime, so many small ones do not cost a task each.
    """
    return df.withColumn("partition", F.pmod(F.hash(key), F.lit(1 << bits))).repartition("partition")


def partition_totals(df: DataFrame, key: str = "key", bits: int = 10) -> DataFrame:
    """(rows, key_sum) over all partitions: must equal the totals of the input."""
    per_part = radix_partition(df, key, bits).groupBy("partition").agg(
        F.count("*").alias("n"), F.sum(F.col(key).cast("decimal(38,0)")).alias("s")
    )
    return per_part.agg(F.sum("n").alias("n_rows"), F.sum("s").cast("bigint").alias("key_sum"))


def split_keys(df: DataFrame, key: str = "key", bits: int = 10) -> DataFrame:
    """(n_keys, n_split, in_range): distinct keys, those whose rows were dealt to more than one task or label, and whether all labels are below 2^bits."""
    dealt = radix_partition(df, key, bits).withColumn("task", F.spark_partition_id())
    place = F.struct("task", "partition")
    per_key = dealt.groupBy(key).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    inside = (F.min("low.partition") >= 0) & (F.max("high.partition") < (1 << bits))
    return per_key.agg(F.count("*").alias("n_keys"), F.sum((F.col("low") != F.col("high")).cast("bigint")).alias("n_split"), inside.alias("in_range"))


def partitioned_join(build: DataFrame, probe: DataFrame, bits: int = 10) -> DataFrame:
    """(key, build_payload, probe_payload): both relations dealt by key into 2^bits partitions, joined partition by partition without another exchange."""
    left = build.select("key", F.col("payload").alias("build_payload")).repartition(1 << bits, "key")
    right = probe.select("key", F.col("payload").alias("probe_payload")).repartition(1 << bits, "key")
    return right.join(left.hint("shuffle_hash"), "key").select("key", "build_payload", "probe_payload")
