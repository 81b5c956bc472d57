"""Every query of the catalog against its SQL."""

import pytest

from fleetlens.plans import catalog, oracle, runs, runs_oracle
from fleetlens.operators import rules
from tests.oracle_tools import assert_same


QUERIES, SQL = catalog.QUERIES | runs.QUERIES, oracle.SQL | runs_oracle.SQL


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL) and not set(catalog.QUERIES) & set(runs.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    assert_same(spark, small, QUERIES[name], SQL[name])


def test_figures_make_every_rule_and_check_fire(spark, small):
    found = runs.rule_figures(spark, small).select("priority").distinct().collect()
    assert {r.priority for r in found} >= {r.priority for r in rules.RULES}
    checks = {(r.name, r.passed) for r in runs.gate_figures(spark, small).select("name", "passed").distinct().collect()}
    assert len(checks) == 16


def test_profile_has_one_exchange(spark, small):
    plan = catalog.QUERIES["profile_full"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
