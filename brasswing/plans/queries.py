"""Named queries over the relational tables, each with the SQL an independent engine can check.

``queries()`` gives DataFrame plans; ``oracle_sql()`` gives the same results in
plain SQL over the raw files. Sums are decimals or integers, never doubles, so
both sides agree to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.engine import Engine
from brasswing.functions.registry import default_registry
from brasswing.operators import aggregates as A
from brasswing.operators import expressions as X
from brasswing.operators import joins as J
from brasswing.operators import keyed, ordering, partitioning
from brasswing.plans import statistics
from brasswing.session import shared_dir
from brasswing.tables import load, oracle_view

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under ``name``; ``{table}`` in ``sql`` is the table at its boundary types."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            views = {t: oracle_view(t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
            _ORACLES[name] = sql.format(**views).strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _simple(name: str, table: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, sql)(lambda spark, d: plan(load(spark, d, table)))



def price() -> Column:
    """Discounted price of a line."""
    return c("l_extendedprice") * (F.lit(1) - c("l_discount"))


day = lambda s: F.lit(s).cast("date")

# ---- benchmark-shaped queries -------------------------------------------


@query(
    "q6_revenue",
    """SELECT CAST(SUM(l_extendedprice * l_discount) AS DECIMAL(38,4)) AS revenue FROM {lineitem}
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def q6_revenue(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem", {"l_discount": (0.05, 0.07), "l_quantity": (None, 24)}).filter(
        (c("l_shipdate") >= day("1996-01-01"))
        & (c("l_shipdate") < day("1997-01-01"))
        & F.expr("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    )
    return A.scalar(rows, A.sum_of(c("l_extendedprice") * c("l_discount"), 38, 4).alias("revenue"))


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS DECIMAL(38,2)) AS sum_qty,
      CAST(SUM(l_extendedprice) AS DECIMAL(38,2)) AS sum_base_price,
      CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS sum_disc_price,
      CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4)) * CAST(1 + l_tax AS DECIMAL(10,2))) AS DECIMAL(38,6)) AS sum_charge,
      CAST(CAST(SUM(l_quantity) * 100 AS HUGEINT) // COUNT(*) AS BIGINT) AS avg_qty_cents, COUNT(*) AS count_order
    FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    net = price().cast("decimal(20,4)")
    return A.grouped(
        load(spark, d, "lineitem").filter(c("l_shipdate") <= day("1998-09-02")),
        ["l_returnflag", "l_linestatus"],
        A.sum_of(c("l_quantity"), 38, 2).alias("sum_qty"),
        A.sum_of(c("l_extendedprice"), 38, 2).alias("sum_base_price"),
        A.sum_of(net, 38, 4).alias("sum_disc_price"),
        A.sum_of(net * (F.lit(1) + c("l_tax")).cast("decimal(10,2)"), 38, 6).alias("sum_charge"),
        A.avg_trunc("l_quantity").alias("avg_qty_cents"),
        F.count("*").alias("count_order"),
    )


@query(
    "q3_shipping_priority",
    """SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS revenue, o_orderdate
    FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey JOIN {lineitem} l ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def q3_shipping_priority(spark: SparkSession, d: str) -> DataFrame:
    customers = load(spark, d, "customer").filter(c("c_mktsegment") == "BUILDING")
    orders = load(spark, d, "orders").filter(c("o_orderdate") < day("1998-03-15"))
    lines = load(spark, d, "lineitem").filter(c("l_shipdate") > day("1998-03-15"))
    joined = J.equi_join(lines, J.equi_join(orders, customers, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    sums = A.grouped(joined, ["l_orderkey", "o_orderdate"], A.sum_of(price().cast("decimal(20,4)"), 38, 4).alias("revenue"))
    return ordering.top_k(sums.select("l_orderkey", "revenue", "o_orderdate"), 10, "revenue desc", "o_orderdate", "l_orderkey")


@query(
    "q4_exists_semi",
    """SELECT o_orderpriority, COUNT(*) AS order_count FROM {orders} o
    WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
      AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)
    GROUP BY o_orderpriority""",
)
def q4_exists_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").filter(
        (c("o_orderdate") >= day("1996-01-01")) & (c("o_orderdate") < day("1997-01-01"))
    )
    big = load(spark, d, "lineitem", {"l_quantity": (40, None)}).filter(c("l_quantity") > 40).select("l_orderkey")
    return A.grouped(J.exists(orders, big, [("o_orderkey", "l_orderkey")]), ["o_orderpriority"], F.count("*").alias("order_count"))


@query(
    "q5_local_supplier",
    """SELECT n_name, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS revenue
    FROM {customer} c, {orders} o, {lineitem} l, {supplier} s, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
      AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
    GROUP BY n_name""",
)
def q5_local_supplier(spark: SparkSession, d: str) -> DataFrame:
    t = {n: load(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    nations = J.equi_join(t["nation"], t["region"].filter(c("r_name") == "ASIA"), [("n_regionkey", "r_regionkey")])
    suppliers = J.equi_join(t["supplier"], nations, [("s_nationkey", "n_nationkey")])
    orders = t["orders"].filter((c("o_orderdate") >= day("1996-01-01")) & (c("o_orderdate") < day("1998-01-01")))
    lines = J.equi_join(t["lineitem"], J.broadcast_if_small(suppliers), [("l_suppkey", "s_suppkey")])
    with_order = J.equi_join(lines, orders, [("l_orderkey", "o_orderkey")])
    full = J.equi_join(with_order, t["customer"], [("o_custkey", "c_custkey"), ("s_nationkey", "c_nationkey")])
    return A.grouped(full, ["n_name"], A.sum_of(price().cast("decimal(20,4)"), 38, 4).alias("revenue"))


@query(
    "q14_promo_ratio",
    """SELECT CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4)) ELSE 0 END) AS DECIMAL(38,4)) AS promo,
      CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS total,
      ROUND(CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4)) ELSE 0 END) AS DOUBLE)
        / CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DOUBLE), 6) AS ratio
    FROM {lineitem} l, {part} p WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1997-09-01'""",
)
def q14_promo_ratio(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").filter(
        (c("l_shipdate") >= day("1996-09-01")) & (c("l_shipdate") < day("1997-09-01"))
    )
    joined = J.equi_join(lines, load(spark, d, "part"), [("l_partkey", "p_partkey")])
    net = price().cast("decimal(20,4)")
    promo = X.case([(X.like(c("p_type"), "PROMO%"), net)], F.lit(0).cast("decimal(20,4)"))
    sums = A.scalar(joined, A.sum_of(promo, 38, 4).alias("promo"), A.sum_of(net, 38, 4).alias("total"))
    return sums.select("promo", "total", A.ratio(c("promo"), c("total")).alias("ratio"))


@query(
    "q19_or_across_tables",
    """SELECT CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DECIMAL(38,4)) AS revenue, COUNT(*) AS n_lines
    FROM {lineitem} l, {part} p WHERE l_partkey = p_partkey AND (
      (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 15 AND p_size BETWEEN 1 AND 10)
      OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 25 AND p_size BETWEEN 1 AND 20)
      OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 35 AND p_size BETWEEN 1 AND 30))""",
)
def q19_or_across_tables(spark: SparkSession, d: str) -> DataFrame:
    joined = J.equi_join(load(spark, d, "lineitem"), load(spark, d, "part"), [("l_partkey", "p_partkey")])
    branch = lambda b, lo, hi, size: (
        (c("p_brand") == b) & c("l_quantity").between(lo, hi) & c("p_size").between(1, size)
    )
    any_of = branch("Brand#1", 1, 15, 10) | branch("Brand#2", 10, 25, 20) | branch("Brand#3", 20, 35, 30)
    return A.scalar(joined.filter(any_of), A.sum_of(price().cast("decimal(20,4)"), 38, 4).alias("revenue"), F.count("*").alias("n_lines"))


# ---- scans and predicates -----------------------------------------------

_simple("scan_star", "nation", lambda t: t.select("*"), "SELECT * FROM nation")
_simple("project_alias", "supplier", lambda t: t.select(c("s_suppkey").alias("id"), c("s_acctbal").alias("balance"), "s_name"), "SELECT s_suppkey AS id, s_acctbal AS balance, s_name FROM {supplier}")
_simple("filter_eq_str", "customer", lambda t: t.filter(c("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'MACHINERY'")
_simple("filter_ne", "orders", lambda t: t.filter(c("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus <> 'F'")
_simple("filter_range", "orders", lambda t: t.filter((c("o_orderdate") >= day("1997-03-01")) & (c("o_orderdate") < day("1997-04-01"))).select("o_orderkey", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-01'")
_simple("filter_between", "lineitem", lambda t: t.filter(F.expr("l_discount BETWEEN 0.05 AND 0.07")).select("l_orderkey", "l_linenumber", "l_discount"), "SELECT l_orderkey, l_linenumber, l_discount FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07")
_simple("filter_between_reversed", "lineitem", lambda t: A.scalar(t.filter(c("l_linenumber").between(7, 5)), F.count("*").alias("n")), "SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 7 AND 5")
_simple("filter_in_str", "part", lambda t: t.filter(c("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM {part} WHERE p_type IN ('PROMO', 'SMALL')")
_simple("filter_in_int", "part", lambda t: t.filter(c("p_size").isin(1, 7, 49)).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 7, 49)")
_simple("filter_in_date", "orders", lambda t: t.filter(c("o_orderdate").isin(day("1997-03-01"), day("1998-01-15"))).select("o_orderkey", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate IN (DATE '1997-03-01', DATE '1998-01-15')")
_simple("filter_or", "part", lambda t: t.filter((c("p_size") < 3) | (c("p_brand") == "Brand#5") & (c("p_size") > 40)).select("p_partkey"), "SELECT p_partkey FROM {part} WHERE p_size < 3 OR p_brand = 'Brand#5' AND p_size > 40")
_simple("filter_string_order", "nation", lambda t: t.filter(c("n_name") >= "NATION_2").select("n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_name >= 'NATION_2'")
_simple("like_prefix", "part", lambda t: t.filter(X.like(c("p_type"), "S%")).select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE 'S%'")
_simple("like_suffix", "nation", lambda t: t.filter(X.like(c("n_name"), "%4")).select("n_name"), "SELECT n_name FROM nation WHERE n_name LIKE '%4'")
_simple("like_contains", "nation", lambda t: t.filter(X.like(c("n_name"), "%ION_1%")).select("n_name"), "SELECT n_name FROM nation WHERE n_name LIKE '%ION_1%'")
_simple("like_inner", "customer", lambda t: t.filter(X.like(c("c_mktsegment"), "_U%G")).select("c_custkey"), "SELECT c_custkey FROM {customer} WHERE c_mktsegment LIKE '_U%G'")

# ---- expressions ----------------------------------------------------------

_simple("arith_mix", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", (c("l_extendedprice") + c("l_tax")).cast("decimal(20,2)").alias("plus"), (c("l_extendedprice") - c("l_discount")).cast("decimal(20,2)").alias("minus"), (c("l_quantity") * c("l_tax")).cast("decimal(20,4)").alias("times"), ((c("l_quantity") + c("l_tax")) * c("l_discount")).cast("decimal(30,4)").alias("mixed")), "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice + l_tax AS DECIMAL(20,2)) AS plus, CAST(l_extendedprice - l_discount AS DECIMAL(20,2)) AS minus, CAST(l_quantity * l_tax AS DECIMAL(20,4)) AS times, CAST((l_quantity + l_tax) * l_discount AS DECIMAL(30,4)) AS mixed FROM {lineitem}")
_simple("int_div", "orders", lambda t: t.select("o_orderkey", X.int_div(c("o_orderkey"), F.lit(7)).alias("q"), X.int_div(-c("o_orderkey"), F.lit(7)).alias("nq")), "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q, CAST((-o_orderkey) // 7 AS BIGINT) AS nq FROM orders")
_simple("dec_div", "lineitem", lambda t: A.scalar(t, F.round(X.dec_div(A.sum_of(c("l_extendedprice"), 20, 2), A.sum_of(c("l_quantity"), 17, 2)).cast("double"), 6).alias("unit_price")), "SELECT ROUND(CAST(SUM(l_extendedprice) AS DOUBLE) / CAST(SUM(l_quantity) AS DOUBLE), 6) AS unit_price FROM {lineitem}")
_simple("case_else", "part", lambda t: t.select("p_partkey", X.case([(c("p_size") < 10, F.lit("small")), (c("p_size") < 30, F.lit("medium"))], F.lit("large")).alias("class")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM {part}")
_simple("case_no_else", "part", lambda t: t.select("p_partkey", X.case([(c("p_size") < 10, c("p_size"))]).alias("v")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size END AS v FROM {part}")
_simple("cast_dec_int", "supplier", lambda t: t.select("s_suppkey", c("s_acctbal").cast("int").alias("whole"), c("s_suppkey").cast("decimal(16,2)").alias("wide")), "SELECT s_suppkey, CAST(trunc(s_acctbal) AS INTEGER) AS whole, CAST(s_suppkey AS DECIMAL(16,2)) AS wide FROM {supplier}")
_simple("cast_bool", "part", lambda t: t.select("p_partkey", (c("p_size") - 1).cast("boolean").alias("flag"), (c("p_size") > 25).cast("int").alias("big")), "SELECT p_partkey, CAST(p_size - 1 AS BOOLEAN) AS flag, CAST(p_size > 25 AS INTEGER) AS big FROM {part}")
_simple("date_interval", "orders", lambda t: t.select("o_orderkey", X.add_interval(c("o_orderdate"), 91, "day").alias("d91"), X.add_interval(c("o_orderdate"), 3, "month").alias("m3"), X.add_interval(c("o_orderdate"), -1, "year").alias("y1")), "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '91' DAY AS DATE) AS d91, CAST(o_orderdate + INTERVAL '3' MONTH AS DATE) AS m3, CAST(o_orderdate - INTERVAL '1' YEAR AS DATE) AS y1 FROM {orders}")
_simple("constant_folding", "region", lambda t: t.filter(c("r_regionkey") < F.lit(1) + F.lit(2)).select("r_name", (F.lit(2) * F.lit(3)).alias("six")), "SELECT r_name, 2 * 3 AS six FROM region WHERE r_regionkey < 1 + 2")

# ---- aggregation -----------------------------------------------------------

_simple("agg_scalar", "orders", lambda t: A.scalar(t, F.count("*").alias("n"), A.sum_of(c("o_totalprice"), 38, 2).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_totalprice").alias("top")), "SELECT COUNT(*) AS n, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, MIN(o_orderdate) AS first, MAX(o_totalprice) AS top FROM {orders}")
_simple("agg_empty", "orders", lambda t: A.scalar(t.filter(c("o_orderkey") < 0), F.count("*").alias("n"), A.sum_of(c("o_totalprice"), 38, 2).alias("total"), F.min("o_orderdate").alias("first"), A.avg_trunc("o_totalprice").alias("mean")), "SELECT COUNT(*) AS n, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, MIN(o_orderdate) AS first, CAST(NULL AS BIGINT) AS mean FROM {orders} WHERE o_orderkey < 0")
_simple("group_minmax", "lineitem", lambda t: A.grouped(t, ["l_suppkey"], F.min("l_shipdate").alias("first"), F.max("l_extendedprice").alias("top"), F.count("*").alias("n")), "SELECT l_suppkey, MIN(l_shipdate) AS first, MAX(l_extendedprice) AS top, COUNT(*) AS n FROM {lineitem} GROUP BY l_suppkey")
_simple("group_only_distinct", "lineitem", lambda t: A.grouped(t, ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
_simple("group_many_partitioned", "lineitem", lambda t: A.partitioned(t, ["l_orderkey"], A.sum_of(c("l_quantity"), 38, 2).alias("qty"), F.count("*").alias("n")), "SELECT l_orderkey, CAST(SUM(l_quantity) AS DECIMAL(38,2)) AS qty, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey")
_simple("avg_trunc", "orders", lambda t: A.grouped(t, ["o_orderpriority"], A.avg_trunc("o_totalprice").alias("mean_cents")), "SELECT o_orderpriority, CAST(CAST(SUM(o_totalprice) * 100 AS HUGEINT) // COUNT(*) AS BIGINT) AS mean_cents FROM {orders} GROUP BY o_orderpriority")
_simple("sum_int", "part", lambda t: A.grouped(t, ["p_brand"], F.sum("p_size").cast("bigint").alias("sizes")), "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand")
_simple("agg_ratio", "lineitem", lambda t: A.grouped(t, ["l_returnflag"], A.ratio(F.sum(c("l_extendedprice") * c("l_discount")), F.sum("l_extendedprice")).alias("share")), "SELECT l_returnflag, ROUND(CAST(SUM(l_extendedprice * l_discount) AS DOUBLE) / CAST(SUM(l_extendedprice) AS DOUBLE), 6) AS share FROM {lineitem} GROUP BY l_returnflag")
_simple("agg_conditional", "orders", lambda t: A.grouped(t, ["o_orderstatus"], F.sum(X.case([(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(1))], F.lit(0))).cast("bigint").alias("high"), F.count("*").alias("n")), "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus")

# ---- joins ------------------------------------------------------------------


@query("join_broadcast", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return J.broadcast_join(load(spark, d, "nation"), load(spark, d, "region"), [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("join_shuffle_hash", "SELECT o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey")
def join_shuffle_hash(spark: SparkSession, d: str) -> DataFrame:
    return J.partitioned_hash_join(load(spark, d, "orders"), load(spark, d, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("join_filtered_hash", "SELECT l_orderkey, l_linenumber, o_orderdate FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1995-02-01'")
def join_filtered_hash(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").filter(c("o_orderdate") < day("1995-02-01"))
    return J.filtered_hash_join(load(spark, d, "lineitem"), orders, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("join_nl_theta", "SELECT a.r_name AS low, b.r_name AS high FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
def join_nl_theta(spark: SparkSession, d: str) -> DataFrame:
    a, b = load(spark, d, "region").alias("a"), load(spark, d, "region").alias("b")
    return J.theta_join(a, b, c("a.r_regionkey") < c("b.r_regionkey")).select(c("a.r_name").alias("low"), c("b.r_name").alias("high"))


@query("join_self", "SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "supplier").select(c("s_nationkey").alias("left_nation"), c("s_suppkey").alias("left_key"))
    b = load(spark, d, "supplier").select(c("s_nationkey").alias("right_nation"), c("s_suppkey").alias("right_key"))
    return J.blocked_join(a, b, ("left_nation", "right_nation"), c("left_key") < c("right_key")).select("left_key", "right_key")


@query("join_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    b = load(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), "l_quantity")
    return J.equi_join(a, b, [("l_orderkey", "k"), ("l_linenumber", "n")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("join_residual_theta", "SELECT c_custkey, s_suppkey FROM {customer} c JOIN {supplier} s ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal WHERE c_mktsegment = 'BUILDING'")
def join_residual_theta(spark: SparkSession, d: str) -> DataFrame:
    customers = load(spark, d, "customer").filter(c("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return J.blocked_join(customers, suppliers, ("c_nationkey", "s_nationkey"), c("c_acctbal") < c("s_acctbal")).select("c_custkey", "s_suppkey")


@query("join_salted", "SELECT o_orderpriority, COUNT(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    orders = load(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return A.grouped(J.salted_join(lines, orders, "l_orderkey", hot_rows=6), ["o_orderpriority"], F.count("*").alias("n"))


@query("cross_small", "SELECT r_name, n_name FROM region, nation")
def cross_small(spark: SparkSession, d: str) -> DataFrame:
    return J.cross_product(load(spark, d, "region"), load(spark, d, "nation")).select("r_name", "n_name")


@query("comma_join", "SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def comma_join(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT s_name, n_name, r_name FROM {s}, {n}, {r} WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
        s=load(spark, d, "supplier"), n=load(spark, d, "nation"), r=load(spark, d, "region"),
    )


# ---- order and limit -----------------------------------------------------------

_simple("topk_offset", "orders", lambda t: ordering.top_k(t.select("o_orderkey", "o_totalprice"), 20, "o_totalprice desc", "o_orderkey", offset=5), "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_simple("order_multi", "customer", lambda t: ordering.order_by(t.select("c_nationkey", "c_acctbal", "c_custkey"), "c_nationkey", "c_acctbal desc", "c_custkey"), "SELECT c_nationkey, c_acctbal, c_custkey FROM {customer} ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
_simple("limit_ordered", "nation", lambda t: ordering.top_k(t, 7, "n_nationkey"), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 7")
_simple("limit_any", "lineitem", lambda t: A.scalar(ordering.limit(t, 13), F.count("*").alias("n")), "SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem LIMIT 13)")

# ---- catalog, statistics, functions, keyed tables ---------------------------------


@query("show_tables", "SELECT 'lineitem' AS name, COUNT(*) AS n_records, CAST(ceil(COUNT(*) / 256.0) AS BIGINT) AS n_tiles FROM lineitem UNION ALL SELECT 'nation', COUNT(*), CAST(ceil(COUNT(*) / 256.0) AS BIGINT) FROM nation")
def show_tables(spark: SparkSession, d: str) -> DataFrame:
    counts = [load(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n_records")) for n in ("lineitem", "nation")]
    return counts[0].unionByName(counts[1]).withColumn("n_tiles", F.ceil(c("n_records") / 256).cast("bigint"))


@query("describe_lineitem", "SELECT column_name AS attribute, CASE WHEN column_name IN ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') THEN 'decimal(16,2)' WHEN column_name = 'l_shipdate' THEN 'date' WHEN column_name IN ('l_returnflag', 'l_linestatus') THEN 'string' WHEN column_name = 'l_linenumber' THEN 'int' ELSE 'bigint' END AS type, column_name IN ('l_orderkey', 'l_linenumber') AS primary_key FROM (DESCRIBE lineitem)")
def describe_lineitem(spark: SparkSession, d: str) -> DataFrame:
    from brasswing.tables import PRIMARY_KEYS

    rows = [(n, t, n in PRIMARY_KEYS["lineitem"]) for n, t in load(spark, d, "lineitem").dtypes]
    return spark.createDataFrame(rows, "attribute string, type string, primary_key boolean")


query("column_stats")(lambda spark, d: statistics.column_stats(load(spark, d, "lineitem")))


@query("column_counts_exact", "SELECT 'o_orderstatus' AS attribute, COUNT(*) AS n_rows, COUNT(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', COUNT(*), COUNT(DISTINCT o_custkey) FROM orders")
def column_counts_exact(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    per = [orders.groupBy(k).count().agg(F.lit(k).alias("attribute"), F.sum("count").alias("n_rows"), F.count(k).alias("n_distinct")) for k in ("o_orderstatus", "o_custkey")]
    return per[0].unionByName(per[1])


@query("histogram_singleton", "SELECT o_orderpriority AS value, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
def histogram_singleton(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.singleton(load(spark, d, "orders"), "o_orderpriority") or {}
    return spark.createDataFrame(list(found.items()), "value string, n bigint")


@query("column_stats_close", " UNION ALL ".join(f"SELECT '{n}' AS attribute, COUNT(*) AS n_rows, TRUE AS close FROM orders" for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def column_stats_close(spark: SparkSession, d: str) -> DataFrame:
    """Whether the distinct counts are within 15 % (three standard errors) of the exact ones."""
    orders = load(spark, d, "orders")
    exact = orders.agg(*[F.count_distinct(n).alias(n) for n in orders.columns])
    pairs = exact.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("exact")) for n in orders.columns])).alias("e")).select("e.*")
    return statistics.column_stats(orders).join(pairs, "column").select(c("column").alias("attribute"), "n_rows", (F.abs(c("n_distinct") - c("exact")) <= 0.15 * c("exact")).alias("close"))


@query("histogram_equidepth_ranks", "SELECT 256 AS bins, COUNT(*) AS n_rows, CAST(MIN(o_totalprice) AS DOUBLE) AS low, CAST(MAX(o_totalprice) AS DOUBLE) AS high, CAST(256 AS BIGINT) AS n_close FROM {orders}")
def histogram_equidepth_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Bins of the equi-depth histogram whose upper bound has the rank it should have, within a thousandth of the rows."""
    orders = load(spark, d, "orders")
    found = statistics.equi_depth(orders, "o_totalprice")
    n = F.count(F.lit(1))
    ranks = orders.agg(n.alias("n_rows"), *[F.sum((c("o_totalprice").cast("double") <= high).cast("bigint")).alias(f"r{i}") for i, (_, high, _) in enumerate(found)])
    close = F.lit(0).cast("bigint")
    for i in range(len(found)):
        close = close + (F.abs(c(f"r{i}") - c("n_rows") * (i + 1) / len(found)) <= c("n_rows") / 1000 + 1).cast("bigint")
    return ranks.select(F.lit(len(found)).alias("bins"), "n_rows", F.lit(found[0][0]).alias("low"), F.lit(found[-1][1]).alias("high"), close.alias("n_close"))


@query("histogram_equidepth")
def histogram_equidepth(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(statistics.equi_depth(load(spark, d, "orders"), "o_totalprice"), "low double, high double, depth double")


def _test_sql() -> str:
    """The fifteen steps of ``test`` on cents, one sub-select a step."""
    sql = "SELECT l_orderkey, l_linenumber, CAST(o_totalprice * 100 AS BIGINT) AS r, CAST(l_extendedprice * 100 AS BIGINT) AS b FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey"
    for i in range(15):
        sql = f"SELECT l_orderkey, l_linenumber, r + b * CASE WHEN {i} % 5 = 0 OR r % 5 = 0 THEN 2 ELSE 1 END AS r, b FROM ({sql})"
    return f"SELECT l_orderkey, l_linenumber, CAST(CAST(r AS DECIMAL(18,0)) * 0.01 AS DECIMAL(16,2)) AS test FROM ({sql})"


@query("udf_test", _test_sql())
def udf_test(spark: SparkSession, d: str) -> DataFrame:
    joined = J.equi_join(load(spark, d, "lineitem"), load(spark, d, "orders"), [("l_orderkey", "o_orderkey")])
    return joined.select("l_orderkey", "l_linenumber", default_registry().install(spark).call("test", "o_totalprice", "l_extendedprice").alias("test"))


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Half of the customers as the table; all of them, with another value, as the batch."""
    customers = load(spark, d, "customer")
    table = customers.filter(c("c_custkey") % 2 == 0).select(c("c_custkey").alias("key"), c("c_nationkey").cast("bigint").alias("value"))
    return table, customers.select(c("c_custkey").alias("key"), (c("c_custkey") * 10).alias("value"))


query("kv_insert", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE c_custkey * 10 END AS value FROM customer")(lambda s, d: keyed.insert(*_keyed(s, d)))
query("kv_lookup", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END AS value, c_custkey % 2 = 0 AS found FROM customer")(lambda s, d: keyed.lookup(*_keyed(s, d)))
query("kv_update", "SELECT c_custkey AS key, c_custkey * 10 AS value FROM customer WHERE c_custkey % 2 = 0")(lambda s, d: keyed.update(*_keyed(s, d)))
query("kv_update_missing", "SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 1")(lambda s, d: keyed.missing(*_keyed(s, d)))


@query("radix_partition_check", "SELECT COUNT(*) AS n_rows, CAST(SUM(l_orderkey) AS BIGINT) AS key_sum FROM lineitem")
def radix_partition_check(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.partition_totals(load(spark, d, "lineitem"), "l_orderkey").withColumn("n_rows", c("n_rows").cast("bigint"))


# Deal customers as a fill phase and orders as a mixed phase of operations, in the order of seq.
_REPLAY = """
    WITH ops AS (
      SELECT c_custkey AS key, -2000000000 + c_custkey AS seq, 'INSERT' AS op, c_custkey * 10 AS value FROM customer WHERE c_custkey % 3 <> 0
      UNION ALL
      SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'READ' END, o_orderkey FROM orders),
    born AS (SELECT *, SUM(CASE WHEN op = 'INSERT' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS inserts FROM ops),
    written AS (SELECT *, CASE WHEN (op = 'INSERT' AND inserts = 1) OR (op = 'UPDATE' AND inserts > 0) THEN value END AS w FROM born),
    now AS (SELECT *, LAST_VALUE(w IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM written)"""


def _phases(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    customers, orders = load(spark, d, "customer"), load(spark, d, "orders")
    fill = customers.filter(c("c_custkey") % 3 != 0).select(c("c_custkey").alias("key"), c("c_custkey").alias("seq"), F.lit("INSERT").alias("op"), (c("c_custkey") * 10).alias("value"))
    turn = c("o_orderkey") % 4
    mixed = orders.select(c("o_custkey").alias("key"), c("o_orderkey").alias("seq"), F.when(turn == 0, "INSERT").when(turn == 1, "UPDATE").otherwise("READ").alias("op"), c("o_orderkey").alias("value"))
    return spark.createDataFrame([], "key bigint, value bigint"), [fill, mixed]


@query("kv_replay_reads", f"{_REPLAY} SELECT seq, key, v AS value, v IS NOT NULL AS found FROM now WHERE op = 'READ'")
def kv_replay_reads(spark: SparkSession, d: str) -> DataFrame:
    table, phases = _phases(spark, d)
    return keyed.replay_phases(table, phases, "value")[1][1]


@query("kv_replay_table", f"{_REPLAY} SELECT key, ARG_MAX(v, seq) AS value FROM now WHERE v IS NOT NULL GROUP BY key")
def kv_replay_table(spark: SparkSession, d: str) -> DataFrame:
    table, phases = _phases(spark, d)
    return keyed.replay_phases(table, phases, "value")[0]


@query("radix_keys_together", "SELECT COUNT(DISTINCT l_orderkey) AS n_keys, CAST(0 AS BIGINT) AS n_split, TRUE AS in_range FROM lineitem")
def radix_keys_together(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.split_keys(load(spark, d, "lineitem"), "l_orderkey")


@query("radix_join_text", "SELECT o_custkey AS key, c_nationkey AS build_payload, o_orderkey AS probe_payload FROM orders JOIN customer ON o_custkey = c_custkey")
def radix_join_text(spark: SparkSession, d: str) -> DataFrame:
    """The two relations as text files, read back, partitioned and joined."""
    root = shared_dir(spark)
    load(spark, d, "customer").select(F.concat_ws(" ", "c_custkey", "c_nationkey")).write.text(f"{root}/R.tbl")
    load(spark, d, "orders").select(F.concat_ws("|", "o_custkey", "o_orderkey")).write.text(f"{root}/S.tbl")
    joined = partitioning.partitioned_join(partitioning.read_relation(spark, f"{root}/R.tbl"), partitioning.read_relation(spark, f"{root}/S.tbl"), bits=4)
    return joined.withColumn("build_payload", c("build_payload").cast("int"))


# ---- statements and commands, through the engine --------------------------------------


def _engine(spark: SparkSession, d: str, *names: str) -> Engine:
    engine = Engine(spark)
    for name in names:
        engine.attach(name, load(spark, d, name))
    return engine


_LISTED = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("engine_tables", " UNION ALL ".join(f"""SELECT '{n}' AS "Table", CAST(ceil(COUNT(*) / 256.0) AS BIGINT) AS "#Tiles", COUNT(*) AS "#Records" FROM {n}""" for n in _LISTED))
def engine_tables(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d, *_LISTED)
    for name in _LISTED:
        engine.execute(f".update statistics {name}")
    return engine.execute(".tables")


_PART_DDL = "create table parts (id int primary key, name char(12), price decimal, since date, sold bool null, note char(5) null)"


@query(
    "engine_describe",
    """SELECT * FROM (VALUES ('id', 'INT', FALSE, TRUE, CAST(4 AS BIGINT)), ('name', 'CHAR(12)', FALSE, FALSE, 12), ('price', 'DECIMAL', FALSE, FALSE, 8),
    ('since', 'DATE', FALSE, FALSE, 4), ('sold', 'BOOL', TRUE, FALSE, 1), ('note', 'CHAR(5)', TRUE, FALSE, 5)) AS t("Attribute", "Type", "Is Null", "Primary Key", "Length (Byte)")""",
)
def engine_describe(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute(_PART_DDL)
    return engine.execute(".table parts")


@query(
    "engine_insert",
    """SELECT * FROM (VALUES (1, 'bolt', CAST(2.5 AS DECIMAL(16,2)), DATE '1996-02-29', TRUE, 'short'), (2, 'nut', CAST(0.1 AS DECIMAL(16,2)), DATE '1997-01-01', FALSE, NULL),
    (3, 'washer; flat', CAST(7 AS DECIMAL(16,2)), NULL, NULL, 'trunc')) AS t(id, name, price, since, sold, note)""",
)
def engine_insert(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    script = f"""{_PART_DDL}; create table if not exists parts (x int); -- the second is ignored
    insert into parts values (1, 'bolt', 2.5, date '1996-02-29', true, 'short'), (2, 'nut', 0.1, date '1997-01-01', false, null);
    insert into parts (note, price, id, name) values ('truncated', 7, 3, 'washer; flat'); select * from parts"""
    return engine.run_script(script)[-1]


_ORDERS_DDL = "create table orders2 (o_orderkey bigint primary key, o_custkey bigint, o_orderstatus char(1), o_totalprice decimal, o_orderdate date, o_orderpriority char(6))"
_IMPORTED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, SUBSTRING(o_orderpriority, 1, 6) AS o_orderpriority FROM {orders}"


def _as_text(spark: SparkSession, d: str, separator: str) -> str:
    """Orders as delimited text with a closing separator, and one row that is too short; its path."""
    path = f"{shared_dir(spark)}/orders"
    rows = load(spark, d, "orders").select(F.concat(F.concat_ws(separator, *load(spark, d, "orders").columns), F.lit(separator)).alias("value"))
    rows.unionByName(spark.createDataFrame([(f"1{separator}2",)], "value string")).write.text(path)
    return path


@query("engine_copy", _IMPORTED)
def engine_copy(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute(_ORDERS_DDL)
    engine.execute(f"copy orders2 from '{_as_text(spark, d, '|')}' with (delimiter '|')")
    return engine.execute("select * from orders2")


@query("engine_import", _IMPORTED)
def engine_import(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute(_ORDERS_DDL)
    engine.execute(f".import csv '{_as_text(spark, d, ';')}' into orders2 separated by ';'")
    return engine.execute("select * from orders2")


@query("engine_load_script", "SELECT n_regionkey AS k, COUNT(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey")
def engine_load_script(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/script.sql"
    text = "select 1 as one; -- the last result counts\nselect n_regionkey as k, count(*) as n from nation\nwhere n_nationkey < 20 group by n_regionkey;"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return _engine(spark, d, "nation").execute(f".load file '{path}'")


@query("engine_store_restore", "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ELSEWHERE', 7), (101, 'NOWHERE', NULL))")
def engine_store_restore(spark: SparkSession, d: str) -> DataFrame:
    """Stored, restored, added to, stored onto the same path and restored again."""
    path, engine = shared_dir(spark), _engine(spark, d, "nation")
    engine.execute("insert into nation values (100, 'ELSEWHERE', 7)")
    engine.execute(f".store '{path}'")
    other = Engine(spark)
    other.run_script(f".restore '{path}'; insert into nation (n_name, n_nationkey) values ('NOWHERE', 101); .store '{path}'")
    last = Engine(spark)
    last.execute(f".restore '{path}'")
    return last.execute("select * from nation")


@query("engine_warehouse_append", "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (100, 'A'), (101, 'B'))")
def engine_warehouse_append(spark: SparkSession, d: str) -> DataFrame:
    """Appends to an attached table, with a warehouse."""
    engine = Engine(spark, warehouse=shared_dir(spark))
    engine.attach("region", load(spark, d, "region"))
    engine.run_script("insert into region values (100, 'A'); insert into region values (101, 'B')")
    return engine.execute("select * from region")


@query("engine_case_commas", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small, when' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def engine_case_commas(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d, "part").execute("select p_partkey, case when p_size < 10 then 'small, when', when p_size < 30 then 'medium' else 'large' end as class from part")


@query("engine_cast_char", "SELECT p_partkey, LEFT(p_type, 3) AS t3, LEFT(CAST(p_size AS VARCHAR), 1) AS s1, LEFT(CAST(p_retailprice AS VARCHAR), 4) AS r4 FROM {part}")
def engine_cast_char(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d, "part").execute("select p_partkey, cast(p_type as char(3)) as t3, cast(p_size as char) as s1, cast(cast(p_retailprice as char(9)) as char(4)) as r4 from part")
