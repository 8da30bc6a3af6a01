"""The registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

def test_registry():
    assert set(catalog.SQL) == set(catalog.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows[-1]["label"] == "Итого" and rows[-1]["record_count"] == sum(r["record_count"] for r in rows[:-1])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    from tools.check_queries import TABLES, kinds, normal

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry_point.queries()[name](spark, FOLDER)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(entry_point.oracle_sql()[name])
    theirs = normal(result.fetchall(), [d[0] for d in result.description])
    assert mine == theirs and kinds(mine[1]) == kinds(theirs[1])
