"""Store and restore a whole catalog.

Each ``store`` writes its tables to a new folder and then one more catalog
version, so tables that were restored from the same path are read while they are
written, and a store that fails leaves the last complete version in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CATALOG = "_catalog"
_ROWS = "name string, folder string, schema string, statistics string"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete catalog versions under ``path``, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CATALOG}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(done(f"{path}/{CATALOG}/{n}/_SUCCESS")))


def store(spark: SparkSession, path: str, tables: dict[str, DataFrame], statistics: dict[str, dict]) -> None:
    """Write every table with its schema metadata and statistics under ``path``."""
    folder, rows = f"data-{uuid.uuid4().hex}", []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        rows.append((name, folder, df.schema.json(), json.dumps(statistics.get(name))))
    version = max(_versions(spark, path), default=0) + 1
    spark.createDataFrame(rows, _ROWS).coalesce(1).write.json(f"{path}/{CATALOG}/{version}")


def restore(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """Read back what the last complete ``store`` wrote: tables with their declared schemas, and statistics."""
    tables, statistics = {}, {}
    if not (versions := _versions(spark, path)):
        raise ValueError(f"nothing stored in {path}")
    for row in spark.read.schema(_ROWS).json(f"{path}/{CATALOG}/{versions[-1]}").collect():
        schema = StructType.fromJson(json.loads(row["schema"]))
        tables[row["name"]] = spark.read.schema(schema).parquet(f"{path}/{row['folder']}/{row['name']}")
        if (found := json.loads(row["statistics"] or "null")) is not None:
            statistics[row["name"]] = found
    return tables, statistics
