"""Every registered query with SQL gives the same rows in both engines."""

import pytest

import __spark_entry__ as entry
from nocturne.plans import catalogue
from oracle_check import connect, differences

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in catalogue.BATCH:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert differences(df, duck, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert len(out.columns) == 57 and out.count() > 0
