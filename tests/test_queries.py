"""Every registered query against its SQL, on the smallest given tables."""

import threading

import pytest

import __spark_entry__ as entry
from check import compare, database, kinds

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.fixture(scope="module")
def larger():
    return database("/root/testdata/sf0.01")


def test_every_query_has_sql():
    """The training-data operators have tests of their own for what SQL cannot express."""
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(n == "pipeline" or n.startswith("op") for n in without) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20 and [r.n for r in rows] == sorted((r.n for r in rows), reverse=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df, sql = entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df, sql, db) is None
    assert kinds(df, db.sql(sql)) == []


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_ends_under_a_row_limit(larger, name):
    stop = threading.Timer(60, larger.interrupt)
    stop.start()
    try:
        larger.sql(f"SELECT * FROM ({entry.oracle_sql()[name].strip().rstrip(';')}) LIMIT 5000000").fetchall()
    finally:
        stop.cancel()
