"""What the operators share: the cluster's shared folder, cut lineage, and files reached by URI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.session import shared_dir

#: Rows, and about so many bytes, sent to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that lost executors cost no lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = shared_dir(spark)
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def write(self, df: DataFrame) -> str:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return path

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that no later plan reads."""
        for name in df.inputFiles()[:1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(filesystem, path) of a URI, for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's rows and bytes a batch: a worker and its executor hold whole batches several times over.

    Read when a plan runs, so it stays set; lower values of the caller's own are kept.
    """
    for key, most in ((_BATCH, rows), (_BYTES, size)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns of the input never meet the operator's own."""
    return df.select(*[df[n] for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a few whole numbers that are sent to every executor, at most (about 100 bytes each).
BROADCAST_ROWS = 200_000


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """A written table of thin rows, marked for broadcast if it has ``BROADCAST_ROWS`` at most; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Bits of a key filter: a power of two with about 16 a key, and 64 MB at most. Bits of one of its rows.
FILTER_BITS, FILTER_MAX, FILTER_ROW = 16, 1 << 29, 1 << 15


def key_filter(scratch: Scratch, keys: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A filter of rows whose 64-bit hash ``key`` may be among ``keys`` (a written table of one column), to be applied before an exchange of wide rows.

    The function returned adds a boolean column of the given name. It is true
    for every row whose key is wanted and for one in sixteen others; with more
    than 2^25 keys it lets more through, as its size is bounded. It is a bitmap of
    one bit a key, made and looked up by SQL functions.
    """
    keys = keys.select(F.col(keys.columns[0]).alias("key"))
    bits = FILTER_ROW
    wanted = FILTER_BITS * keys.count()
    while bits < min(wanted, FILTER_MAX):
        bits *= 2

    def slot(key: Column) -> Column:
        return key.bitwiseAND(F.lit(bits - 1))

    rows = keys.groupBy(F.floor(slot(F.col("key")) / FILTER_ROW).alias("row")).agg(F.bitmap_construct_agg(slot(F.col("key")) % FILTER_ROW).alias("bits"))
    rows = scratch.table(rows)

    def maybe(df: DataFrame, name: str, key: str = "key") -> DataFrame:
        row, bitmap = unused(df, "filter_row", "filter_bits")
        at = slot(F.col(key)) % FILTER_ROW
        byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
        placed = df.withColumn(row, F.floor(slot(F.col(key)) / FILTER_ROW))
        joined = placed.join(F.broadcast(rows.select(F.col("row").alias(row), F.col("bits").alias(bitmap))), row, "left")
        return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(row, bitmap)

    return maybe
