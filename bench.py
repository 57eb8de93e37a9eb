"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Each query is
warmed once and then timed three times into the empty sink; the median counts.
``index_5m`` stands beside the total: five million keys inserted into an empty keyed
table, and looked up in a stored one.
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brasswing.operators import keyed  # noqa: E402
from brasswing.plans.queries import queries  # noqa: E402
from brasswing.session import local_session, shared_dir  # noqa: E402
from brasswing.sources.sinks import benchmark, discard  # noqa: E402

HEADLINE = {
    "q1": "q1_pricing_summary",
    "q3": "q3_shipping_priority",
    "q4": "q4_exists_semi",
    "q5": "q5_local_supplier",
    "q6": "q6_revenue",
    "q14": "q14_promo_ratio",
    "q19": "q19_or_across_tables",
    "group": "group_many_partitioned",
    "join": "join_composite",
    "topk": "topk_offset",
    "kv": "kv_insert",
    "radix": "radix_partition_check",
}


#: Keys of the index phases, scrambled by a prime beyond them.
KEYS, PRIME = 5_000_000, 5_000_011


def index_phases(spark) -> dict[str, float]:
    """Median seconds of a fill and a read-only phase of ``KEYS`` operations."""
    batch = spark.range(KEYS).selectExpr(f"id * 7919 % {PRIME} AS key", "id AS value")
    path = f"{shared_dir(spark)}/table"
    batch.write.parquet(path)
    table, empty = spark.read.parquet(path), spark.createDataFrame([], batch.schema)
    phases = {"fill": lambda: keyed.insert(empty, batch), "read": lambda: keyed.lookup(table, batch.select("key"))}
    for phase in phases.values():
        discard(phase())
    return {name: round(benchmark(phase, 3)["median"], 4) for name, phase in phases.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    named, seconds = queries(), {}
    for label, name in HEADLINE.items():
        discard(named[name](spark, sf_dir))
        seconds[label] = round(benchmark(lambda n=name: named[n](spark, sf_dir), 3)["median"], 4)
    total = round(sum(seconds.values()), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf, "index_5m": index_phases(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
