"""The engine: one session catalog, the statement dialect and the dot commands."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from brasswing.dialect import classify, normalise_select, split_script
from brasswing.functions.registry import default_registry
from brasswing.plans import explain, statistics
from brasswing.session import configure, shared_dir
from brasswing.sources import sinks
from brasswing.sources.delimited import read_delimited
from brasswing.sources.store import restore, store

#: Rows counted as one tile in ``.tables``.
TILE_ROWS = 256
#: Appends to a table's plan before it is cut.
PLAN_APPENDS = 16
_FIXED_BYTES = {"int": 4, "bigint": 8, "date": 4, "boolean": 1}


class Engine:
    """Executes statements; every result is a DataFrame (or None for statements without one).

    Tables are append-only DataFrames behind temporary views. With ``warehouse``
    set, a table's first append writes it to a folder of its own there and later
    ones add files to it. Without, an append unions onto the table's plan, which is
    cut by a checkpoint every ``PLAN_APPENDS`` appends.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None) -> None:
        self.spark = configure(spark)
        self.warehouse = warehouse
        self.tables: dict[str, DataFrame] = {}
        self.statistics: dict[str, dict] = {}
        self.functions = default_registry()
        self.stopped = False
        self._folders: dict[str, str] = {}
        self._appends: dict[str, int] = {}
        self.functions.install(spark)

    # ---- catalog -------------------------------------------------------

    def attach(self, name: str, df: DataFrame) -> None:
        """Make ``df`` queryable as table ``name``."""
        self._folders.pop(name, None)
        self._appends.pop(name, None)
        self._show(name, df)

    def _show(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def _append(self, name: str, rows: DataFrame) -> None:
        table = self._table(name)
        if self.warehouse:
            if name not in self._folders:
                folder = f"{self.warehouse}/{name}-{uuid.uuid4().hex}"
                table.write.parquet(folder)
                self._folders[name] = folder
            rows.write.mode("append").parquet(self._folders[name])
            self._show(name, self.spark.read.schema(table.schema).parquet(self._folders[name]))
            return
        joined = table.unionByName(rows)
        self._appends[name] = self._appends.get(name, 0) + 1
        if self._appends[name] % PLAN_APPENDS == 0:
            shared_dir(self.spark)
            joined = joined.checkpoint()
        self._show(name, self.spark.createDataFrame([], table.schema).unionByName(joined) if joined.schema != table.schema else joined)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no such table: {name}")
        return self.tables[name]

    # ---- statements ----------------------------------------------------

    def execute(self, text: str) -> DataFrame | None:
        """Run one statement."""
        if self.stopped:
            raise RuntimeError("the engine was stopped")
        statement = classify(text)
        return getattr(self, f"_do_{statement.kind}")(**statement.args)

    def run_script(self, script: str) -> list[DataFrame | None]:
        """Run the statements of a script in order."""
        return [self.execute(s) for s in split_script(script)]

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(normalise_select(sql))

    def benchmark(self, sql: str, iterations: int = 3, output: str | None = None) -> dict:
        return sinks.benchmark(lambda: self.query(sql), iterations, output)

    def _do_select(self, select: str) -> DataFrame:
        return self.spark.sql(select)

    def _do_explain(self, level: str, select: str) -> DataFrame:
        df = self.spark.sql(select)
        return self.spark.createDataFrame([(x,) for x in explain.lines(df, level)], "plan string")

    def _do_create(self, if_not_exists: bool, name: str, columns: list[dict]) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table exists: {name}")
        fields = []
        for c in columns:
            metadata = {"primary_key": c["primary_key"], "dialect_type": c["dialect"], "null": c["nullable"]}
            if c["length"]:
                metadata["length"] = c["length"]
            fields.append(StructField(c["name"], DataType.fromDDL(c["type"]), True, metadata))
        self.attach(name, self.spark.createDataFrame([], StructType(fields)))

    def _do_insert(self, name: str, columns: list[str] | None, values: str) -> None:
        table = self._table(name)
        columns = columns or table.columns
        if unknown := set(columns) - set(table.columns):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        rows = self.spark.sql(f"SELECT * FROM VALUES {normalise_select(values)}")
        if len(rows.columns) != len(columns):
            raise ValueError(f"{len(columns)} values expected, got {len(rows.columns)}")
        rows = rows.toDF(*columns)
        out = []
        for field in table.schema.fields:
            cell = F.col(field.name).cast(field.dataType) if field.name in columns else F.lit(None).cast(field.dataType)
            if length := field.metadata.get("length"):
                cell = F.substring(cell, 1, length)
            out.append(cell.alias(field.name, metadata=field.metadata))
        self._append(name, rows.select(*out))

    def _do_import(self, name: str, path: str, sep: str | None = None) -> None:
        schema = self._table(name).schema
        self._append(name, read_delimited(self.spark, path, schema, sep or ","))

    # ---- commands ------------------------------------------------------

    def _do_tables(self) -> DataFrame:
        rows = []
        for name in sorted(self.tables):
            n = int(self.statistics.get(name, {}).get("n_rows", 0))
            rows.append((name, -(-n // TILE_ROWS), n))
        return self.spark.createDataFrame(rows, "`Table` string, `#Tiles` bigint, `#Records` bigint")

    def _do_table(self, name: str) -> DataFrame:
        return describe(self.spark, self._table(name))

    def _do_statistics(self, name: str) -> None:
        self.statistics[name] = statistics.analyse(self._table(name))

    def _do_store(self, path: str) -> None:
        store(self.spark, path, self.tables, self.statistics)

    def _do_restore(self, path: str) -> None:
        tables, self.statistics = restore(self.spark, path)
        for name, df in tables.items():
            self.attach(name, df)

    def _do_load(self, path: str) -> DataFrame | None:
        text = "\n".join(r[0] for r in self.spark.read.text(path).toLocalIterator())
        results = self.run_script(text)
        return results[-1] if results else None

    def _do_config(self) -> DataFrame:
        keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
        rows = [(k, self.spark.conf.get(k, "")) for k in keys]
        return self.spark.createDataFrame(rows, "key string, value string")

    def _do_cores(self, n: str) -> None:
        if int(n) < 1:
            raise ValueError("at least one core")
        self.spark.conf.set("spark.sql.shuffle.partitions", n)

    def _do_stop(self) -> None:
        self.stopped = True


def describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(Attribute, Type, Is Null, Primary Key, Length (Byte)) of a table."""
    rows = []
    for f in df.schema.fields:
        simple, meta = f.dataType.simpleString(), f.metadata or {}
        length = meta.get("length") or _FIXED_BYTES.get(simple, 8)
        shown = meta.get("dialect_type") or re.sub(r"^string$", "CHAR", simple).upper()
        rows.append((f.name, shown, bool(meta.get("null", False)), bool(meta.get("primary_key", False)), length))
    return spark.createDataFrame(
        rows, "`Attribute` string, `Type` string, `Is Null` boolean, `Primary Key` boolean, `Length (Byte)` bigint"
    )
