import json
import random

import pytest
from pyspark.sql import functions as F

from brasswing import Engine
from brasswing.dialect import classify, normalise_select, split_script
from brasswing.functions.registry import Function
from brasswing.operators import joins, keyed, partitioning
from brasswing.plans import statistics
from brasswing.plans.queries import queries
from brasswing.sources import sinks
from brasswing.sources.delimited import skipped_rows


def test_script_splitting():
    assert split_script("select 'a;b'; -- note; more\nselect 2;") == ["select 'a;b'", "select 2"]


def test_case_commas():
    assert normalise_select("case when a then ', when', when b then 2 end") == "case when a then ', when' when b then 2 end"


def test_unknown_statements():
    for text in (".nothing", "drop table t", "sample operators select 1"):
        with pytest.raises(ValueError):
            classify(text)


def test_tables_import_store_restore(spark, tmp_path):
    engine = Engine(spark)
    engine.execute("create table t (id int primary key, d decimal, n char(3) null)")
    engine.execute("create table if not exists t (x int)")
    with pytest.raises(ValueError):
        engine.execute("create table t (x int)")
    (tmp_path / "t.csv").write_text("1;2.5;abcdef;\n2;3.25;x\n3;short\n4;1;a;b\n5;1.00;\n")
    engine.execute(f"copy t from '{tmp_path}/t.csv'")
    assert sorted(map(str, (r[2] for r in engine.query("select * from t").collect()))) == ["abc", "x"]
    assert skipped_rows(spark, f"{tmp_path}/t.csv", engine.tables["t"].schema) == 3
    engine.execute("insert into t (n, id) values ('new', 9)")
    engine.execute(".update statistics t")
    assert engine.execute(".tables").collect()[0][2] == 3
    assert [r["Primary Key"] for r in engine.execute(".table t").collect()] == [True, False, False]
    engine.execute(f".store '{tmp_path}/db'")
    other = Engine(spark)
    other.execute(f".restore '{tmp_path}/db'")
    assert other.tables["t"].count() == 3 and other.statistics["t"]["n_rows"] == 3
    other.execute(".stop")
    with pytest.raises(RuntimeError):
        other.execute(".tables")


def test_sample_function(spark):
    def loop(a, b):
        for i in range(15):
            a += b * (2 if i % 5 == 0 or a % 5 == 0 else 1)
        return a

    engine = Engine(spark)
    got = engine.query("select test(12.34, 0.07) as x, test(10, 5) as y").first()
    assert (int(got["x"] * 100), int(got["y"] * 100)) == (loop(1234, 7), loop(1000, 500))
    with pytest.raises(ValueError):
        engine.functions.call("test", "a")


def test_keyed_batches(spark):
    table = spark.createDataFrame([(1, 10), (2, 20)], "key bigint, value bigint")
    batch = spark.createDataFrame([(2, 5, 0), (3, 7, 1), (3, 6, 2), (None, 1, 3)], "key bigint, value bigint, seq bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(keyed.insert(table, batch)) == [(1, 10), (2, 20), (3, 7)]
    assert rows(keyed.update(table, batch)) == [(1, 10), (2, 5)]


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_onto_the_restored_path(spark, tmp_path):
    engine = Engine(spark)
    engine.run_script(f"create table t (id int); insert into t values (1), (2); .store '{tmp_path}/db'")
    engine.run_script(f".restore '{tmp_path}/db'; insert into t values (3); .store '{tmp_path}/db'; .store '{tmp_path}/db'")
    assert values(engine.tables["t"]) == [(1,), (2,), (3,)]
    other = Engine(spark)
    other.execute(f".restore '{tmp_path}/db'")
    assert values(other.tables["t"]) == [(1,), (2,), (3,)]
    # A store that did not finish leaves the last complete one in force.
    (tmp_path / "db/_catalog/9").mkdir()
    other.execute(f".restore '{tmp_path}/db'")
    assert values(other.tables["t"]) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        other.execute(f".restore '{tmp_path}/nothing'")


@pytest.mark.parametrize("warehouse", [False, True])
def test_appends_keep_attached_and_restored_rows(spark, tmp_path, warehouse):
    engine = Engine(spark, warehouse=f"{tmp_path}/warehouse" if warehouse else None)
    engine.attach("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string"))
    engine.run_script("insert into t values (3, 'c'); insert into t (id) values (4)")
    assert values(engine.tables["t"]) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    engine.run_script(f".store '{tmp_path}/db'; .restore '{tmp_path}/db'; insert into t values (5, 'e')")
    assert engine.query("select count(*) as n from t").first()["n"] == 5
    # Another engine on the same warehouse starts with tables of its own.
    other = Engine(spark, warehouse=engine.warehouse)
    other.run_script("create table t (id int, n char(1)); insert into t values (9, 'xy')")
    assert values(other.tables["t"]) == [(9, "x")]


def test_many_inserts_keep_the_plan_flat(spark):
    engine = Engine(spark)
    engine.execute("create table t (id int, d decimal, n char(2))")
    for i in range(40):
        engine.execute(f"insert into t values ({i}, {i}.5, 'abc')")
    plan = engine.tables["t"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") + plan.count("LocalRelation") < 20
    assert engine.query("select count(*) as n, sum(id) as s, min(n) as x from t").first()[:] == (40, 780, "ab")
    assert engine.tables["t"].schema["n"].metadata["length"] == 2


def test_cast_to_char():
    assert normalise_select("cast(a || 'as char(3))' as char(2))") == "LEFT(CAST(a || 'as char(3))' AS STRING), 2)"
    assert normalise_select("cast(cast((x) as char(4)) as char)") == "LEFT(CAST(LEFT(CAST((x) AS STRING), 4) AS STRING), 1)"
    with pytest.raises(ValueError):
        normalise_select("select a as char(3))")


def test_explain_levels(spark):
    engine = Engine(spark)
    engine.attach("t", spark.range(1000))
    explain = lambda level: [r[0] for r in engine.execute(f"explain {level} select id % 7 as k, count(*) as n from t group by id % 7").collect()]
    assert "Aggregate" in json.loads(explain("")[0])[0]["class"]
    flow, tasks = explain("data flow")[0], explain("task graph")[0]
    assert flow.startswith("digraph") and "Aggregate" in flow and "->" in flow and flow != tasks
    assert tasks.count("subgraph") == 2 and "Exchange" in tasks
    assert "generated" in explain("flounder")[0].lower() or "codegen" in explain("asm")[0].lower()
    assert "analysis" in json.loads(explain("times")[0])
    ran = json.loads(explain("performance")[0])
    assert ran["stages"] == 2 and ran["input_rows"] == 1000 and ran["shuffle_write_bytes"] > 0
    load = json.loads(explain("task load")[0])
    assert 0 <= load["load"] <= 1 and load["busy_ms"] >= 0
    assert [json.loads(x)["shuffle_write_bytes"] > 0 for x in explain("task traces")] == [True, False]
    with pytest.raises(ValueError):
        explain("dram bandwidth")


def test_commands(spark, tmp_path):
    engine = Engine(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    engine.execute(".set cores 3")
    assert dict(map(tuple, engine.execute(".config").collect()))["spark.sql.shuffle.partitions"] == "3"
    engine.execute(f".set cores {before}")
    with pytest.raises(ValueError):
        engine.execute(".set cores 0")
    (tmp_path / "s.sql").write_text("create table t (id int); -- note\ninsert into t values (1);\nselect id + 1 as x from t;")
    assert engine.execute(f".load file '{tmp_path}/s.sql'").first()["x"] == 2
    (tmp_path / "t.csv").write_text("5,\n6\n7,8\n")
    engine.execute(f".import csv '{tmp_path}/t.csv' into t")
    assert values(engine.tables["t"]) == [(1,), (5,), (6,)]
    with pytest.raises(ValueError):
        engine.execute("insert into missing values (1)")
    with pytest.raises(ValueError):
        engine.execute("insert into t (y) values (1)")
    with pytest.raises(ValueError):
        engine.execute("insert into t values (1, 2)")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, n string")
    assert [json.loads(x) for x in sinks.to_json(df)] == [{"id": 1, "n": "a"}, {"id": 2}]
    assert "NULL" in sinks.to_text(df) and [r["id"] for r in sinks.rows(df)] == [1, 2]
    summary = Engine(spark).benchmark("select 1 as x", 2, f"{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text()) == summary and len(summary["seconds"]) == 2


def test_statistics_and_estimates(spark):
    rows = [(i, i % 4, "ab"[i % 2], f"s{i}", i % 3 == 0) for i in range(1000)]
    found = statistics.analyse(spark.createDataFrame(rows, "id int, k bigint, n string, s string, b boolean"))
    columns = found["columns"]
    assert found["n_rows"] == 1000 and columns["k"]["n_distinct"] == 4
    assert columns["n"]["singleton"] == {"a": 500, "b": 500} and columns["b"]["singleton"] == {"true": 334, "false": 666}
    assert "singleton" not in columns["s"] and len(columns["id"]["equi_depth"]) == statistics.BINS
    share = lambda *a: statistics.selectivity(found, *a)
    assert share("n", "=", "a") == 0.5 and share("n", "<>", "a") == 0.5 and share("n", "between", "a", "b") == 1.0
    assert abs(share("id", "<", 250) - 0.25) < 0.01 and abs(share("id", ">=", 900) - 0.1) < 0.01 and abs(share("id", "between", 100, 300) - 0.2) < 0.01
    assert abs(share("id", "=", 5) - 0.001) < 0.0002 and share("unknown", "<", 5) == 0.5
    assert statistics.either(0.7, 0.6) == 1.0 and statistics.either(0.25, 0.5) == 0.75
    empty = statistics.analyse(spark.createDataFrame([], "id int, n string"))
    assert empty["n_rows"] == 0 and empty["columns"]["id"]["equi_depth"] == [] and statistics.selectivity(empty, "id", "=", 1) == 0.0
    assert statistics.singleton(spark.range(100), "id") is None


def test_functions_without_sql_text(spark):
    engine = Engine(spark)
    engine.functions.register(Function("twice", ("bigint",), "bigint", build=lambda x: x * 2))
    engine.functions.install(spark)
    assert spark.range(3, 4).select(engine.functions.call("twice", "id").alias("x")).first()["x"] == 6


def test_replay_keeps_the_order_within_a_key(spark):
    rng = random.Random(3)
    ops = [(seq, rng.choice(["INSERT", "READ", "UPDATE"]), rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.randrange(100)) for seq in range(400)]
    table, reads = {1: 7, 2: None}, []
    for seq, op, key, value in ops:
        if key is None:
            continue
        if op == "READ":
            reads.append((seq, key, table.get(key), key in table))
        elif (op == "INSERT") != (key in table):
            table[key] = value
    held = spark.createDataFrame([(1, 7), (2, None)], "key bigint, value bigint")
    after, got = keyed.replay(held, spark.createDataFrame(ops, "seq bigint, op string, key bigint, value bigint"), "value")
    assert sorted(map(tuple, got.collect())) == sorted(reads)
    assert values(after) == sorted(table.items(), key=str)


def test_workload_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("INSERT 5\nREAD 5\nupdate 5\n\nREAD 6\n")
    table, reads = keyed.replay(spark.createDataFrame([], "key bigint, value bigint"), keyed.parse_workload(spark, f"{tmp_path}/w.txt"))
    assert values(table) == [(5, 5)] and sorted((r["key"], r["found"]) for r in reads.collect()) == [(5, True), (6, False)]
    (tmp_path / "bad.txt").write_text("DROP 5\n")
    with pytest.raises(Exception, match="unknown operation"):
        keyed.parse_workload(spark, f"{tmp_path}/bad.txt").collect()


def test_relations_skip_other_lines(spark, tmp_path):
    (tmp_path / "R.tbl").write_text("1 10\n2|20\n\nx\n-3,-30\n4\n")
    assert values(partitioning.read_relation(spark, f"{tmp_path}/R.tbl")) == [(-3, -30), (1, 10), (2, 20)]


def test_salted_join_of_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (None, 1), (3, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (4, "d")], "k int, n string")
    got = joins.salted_join(left, right, "k", salts=4, hot_rows=100)
    want = left.join(right, "k")
    assert values(got.select("k", "v", "n")) == values(want.select("k", "v", "n"))


def test_blocked_join_meets_each_pair_once(spark):
    rng = random.Random(5)
    keys = [None] * 20 + [1] * 400 + [2] * 90 + list(range(3, 60))
    rows = lambda extra: [(k, rng.randrange(1000), i) for i, k in enumerate(keys + extra)]
    lefts, rights = rows([100] * 50), rows([200] * 50 + [1] * 3)
    left = spark.createDataFrame(lefts + [(2, 5, 0)] * 7, "a int, x int, i int")
    right = spark.createDataFrame(rights + [(2, 900, 0)] * 3, "b int, y int, j int")
    want = sorted((*p, *q) for p in lefts + [(2, 5, 0)] * 7 for q in rights + [(2, 900, 0)] * 3 if p[0] is not None and p[0] == q[0] and p[1] < q[1])
    for pairs in (2_000, 20_000, 1 << 24):
        got = joins.blocked_join(left, right, ("a", "b"), F.col("x") < F.col("y"), pairs=pairs)
        assert got.columns == ["a", "x", "i", "b", "y", "j"]
        assert sorted(map(tuple, got.collect())) == want
    nothing = joins.blocked_join(left, right.filter("b = 0"), ("a", "b"), F.col("x") < F.col("y"), pairs=2_000)
    assert nothing.count() == 0


@pytest.mark.parametrize("name", ["join_residual_theta", "join_self"])
def test_pairs_of_one_nation_are_dealt_to_many_tasks(spark, tmp_path, name):
    customers = spark.range(12_000).selectExpr("id AS c_custkey", "7 AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal", "'BUILDING' AS c_mktsegment")
    suppliers = spark.range(6_000).selectExpr("id AS s_suppkey", "7 AS s_nationkey", "CAST(2 * id AS DOUBLE) AS s_acctbal")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    suppliers.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = [r["count"] for r in queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == (sum(2 * i for i in range(6_000)) if name == "join_residual_theta" else 6_000 * 5_999 // 2)
    assert len(sizes) > 1 and max(sizes) < sum(sizes) * 0.75
