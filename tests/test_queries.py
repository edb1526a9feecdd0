"""Every registered query against its SQL in DuckDB (rows only where there is no SQL)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from chronolith.catalog import QUERIES
from tests.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    made = []

    def build(session, sf_dir):
        made.append(queries()[name](session, sf_dir))
        return made[0]

    message, _ = compare(spark, con, name, build, oracle_sql().get(name), SF)
    assert message is None, message
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["series_id", "n", "mae", "mape", "n_zero_actual"]


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
