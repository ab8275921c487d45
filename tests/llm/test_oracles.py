"""Queries that SQL can express against DuckDB's rows."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, connect
from vistrel.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op6_decontamination", "op9_near_dedup", "op13_manifest"])
def test_oracle(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES[name]).df())
