import os

import pytest

import __spark_entry__ as entry_point
from flowweir.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
# Which rows it has depends on the votes of a forest.
UNDETERMINED = {"forest_leaf_proximity"}


def test_every_determined_query_has_a_statement():
    assert set(QUERIES) - set(entry_point.oracle_sql()) == UNDETERMINED
    assert set(QUERIES) <= set(entry_point.queries())


@needs_data
@pytest.mark.parametrize("name", ["capture_verdict", "classification_report", "prepare_canonical"])
def test_query_equals_statement(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    got = entry_point.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected


@needs_data
def test_entry_returns_flows(spark):
    assert entry_point.entry(spark).count() == 68


def test_every_statement_has_its_query():
    import __spark_entry__ as spark_entry

    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
