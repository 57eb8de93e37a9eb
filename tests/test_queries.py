import pytest
from oracle import connect, same

import __spark_entry__ as entry_module
from brasswing.plans import explain
from brasswing.plans import queries as Q
from brasswing.tables import load


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_oracle(spark, sf_dir, name):
    same(Q.queries()[name](spark, sf_dir), connect(sf_dir), Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert Q.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert str(row["revenue"]) == "429647.4684"


def test_registry_is_consistent():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_bounds_reach_the_reader_and_keep_rows(spark, sf_dir):
    bounded = load(spark, sf_dir, "lineitem", {"l_discount": (0.05, 0.07), "l_quantity": (None, 24)})
    plan = explain.text(bounded)
    assert "GreaterThanOrEqual(l_discount" in plan and "LessThanOrEqual(l_quantity" in plan
    wanted = "l_discount BETWEEN 0.05 AND 0.07 AND l_quantity <= 24"
    assert bounded.filter(wanted).count() == load(spark, sf_dir, "lineitem").filter(wanted).count() > 0
