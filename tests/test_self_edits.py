import random

import duckdb
import numpy as np
import pytest

from palimpsest.operators import linediff as D
from palimpsest.plans import queries as Q
from palimpsest.plans.oracles import ORACLE_SQL


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents with more than a million cells of few different lines, without a text, and with an empty one."""
    path = tmp_path_factory.mktemp("self-edits")
    texts = ["\n".join(["Same line.", "", "Same line.", "Other."][k % (4 - n % 3)] for k in range(1100 + 100 * n)) for n in range(3)]
    duckdb.sql("CREATE OR REPLACE TABLE docs (doc_id BIGINT, text VARCHAR)")
    duckdb.executemany("INSERT INTO docs VALUES (?, ?)", list(enumerate([*texts, None, "", "a", "\n" * 13])))
    duckdb.sql(f"COPY docs TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["self_edit_summary", "self_edit_actions"])
def test_long_documents_of_few_lines_as_sql_has_them(spark, folder, name):
    found = Q.QUERIES[name](spark, folder)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    asked = duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(asked)


@pytest.mark.parametrize("seed", range(20))
def test_kept_rows_give_the_same_subsequence(seed, monkeypatch):
    pick = random.Random(seed)
    a, b = (np.array([pick.randrange(3) for _ in range(pick.randrange(1, 40))]) for _ in range(2))
    whole = D.common_subsequence(a, b)
    monkeypatch.setattr(D, "MAX_CELLS", 1)
    assert D.common_subsequence(a, b) == whole
