"""Every SQL-checkable query against its DuckDB statement, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from emberline.fixtures import TABLES
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    verdict = compare(df, con, CHECKS[key])
    assert verdict.startswith("ok"), verdict
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
