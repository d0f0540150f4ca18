"""Every registered query against its SQL oracle on the smallest data set."""

import pytest

import __spark_entry__ as entry_point
from tools.check import compare

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


# Plan nodes that must not occur: cross products, and Python beyond numpy on Arrow batches.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle_db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    if name in ORACLES:
        problem, _ = compare(df, oracle_db, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.columns
        df.collect()


def test_oracles_name_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
