import os

import pytest

import __spark_entry__ as entry
from palimpsest.plans import registered

QUERIES, ORACLE_SQL = registered()

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_oracles_have_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, con.sql(ORACLE_SQL[name]).select(*columns).fetchall()))


@needs_data
def test_flagship(spark):
    rows = entry.queries()["line_diff_summary"](spark, DATA).collect()
    assert rows and all(r.equal_lines >= 0 for r in rows)
