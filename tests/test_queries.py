"""Every registered query against its SQL text, and the shape of its plan."""

import compare
import pytest

import __spark_entry__ as entry
import workload

# the operators for training data have tests of their own
# archives are decoded in Arrow batches
WITH_PYTHON = {"npz_rows"}
QUERIES, ORACLES = workload.QUERIES, workload.ORACLES


@pytest.fixture(scope="module")
def duck():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql_and_plan_is_distributed(spark, duck, name):
    df = QUERIES[name](spark, compare.SF_DIR)
    got = compare.run_spark(df)
    assert got[1]
    assert compare.difference(got, compare.run_sql(duck, ORACLES[name])) is None

    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert "Python" not in plan and "MapInPandas" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
