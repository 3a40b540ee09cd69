import os

import pytest

from palimpsest.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
EDGE = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "a b", "de"), (5, "A b", "de"), (6, "é +1 (509) 555-6973 ssn 123-45-6789 _a@b.c 1.2.3.4", "fr"), (7, "x " * 40, "en"), (-8, "x " * 40, "en")]


def rows(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    return sorted(map(repr, map(tuple, df.select(*columns).collect()))), sorted(map(repr, con.sql(ORACLE_SQL[name]).select(*columns).fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, wanted = rows(spark, con, name, DATA)
    assert got == wanted and got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_edge_rows_equal_sql(spark, name, tmp_path):
    import duckdb

    spark.createDataFrame([(*r, None if r[0] % 2 else "s") for r in EDGE], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(k, k % 3, [0.5 + k / 1000, 0.25]) for k in range(0, 300, 5)] + [(1, None, [1.0]), (50, 1, None), (100, 1, [1.0, None]), (150, 1, [float("nan"), 1.0])]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, wanted = rows(spark, con, name, str(tmp_path))
    assert got == wanted and (len(got) == len(EDGE) or name in ("op11_hard_negatives", "op12_divergence"))
