"""Highlights of lines that are one word."""

import duckdb

from palimpsest.plans import registered


def test_line_of_one_word(spark, tmp_path):
    """A line that is the word itself, in a document whose lines move: the word is smaller than the line with its end."""
    docs = spark.createDataFrame([(3, "The\nthe\nx\ntion\nab"), (4, "the\nthe")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = registered()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("line_tints", "column_layers"):
        got = queries[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, con.sql(sql[name]).select(*columns).fetchall()))
