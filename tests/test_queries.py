"""Every registered query over the reference's operators against its oracle, or at least its rows."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, connect
from vistrel.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir: str):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_no_cross_join_in_retrieval(spark, sf_dir):
    plan = QUERIES["retrieval_cmc_map"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
