import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from palimpsest.operators import diff as P
from palimpsest.operators import gridalign as G


def texts(n: int, most: int = 12) -> list[tuple[str, str]]:
    rng = random.Random(5)
    words = ["", "a", "b", "}", "é", "long line"]
    def text() -> str:
        return "\n".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    return [("", ""), ("", "a"), ("a\n", ""), ("\n", "\n\n"), *((text(), text()) for _ in range(n))]


@pytest.mark.parametrize("options", [P.Options(), P.Options(actions=True, mappings=False), P.Options(alignment=True), P.Options(highlights=True)])
def test_rows_built_by_columns_are_those_of_single_pairs(spark, options):
    schema = to_arrow_schema(_parse_datatype_string(f"pair_id string, {P.ROW}"))
    rows = P._LineRows(schema, options)
    want = []
    for k, (src, dst) in enumerate(texts(200)):
        mode, lang = ("language", None) if k % 2 else ("conflict", "python")
        rows.add(str(k), src, dst, mode, lang)
        want.append({"pair_id": str(k), **P.compare_row(src, dst, mode, lang, lang, options)})
    got = rows.batch()
    got.validate(full=True)
    assert got.equals(pa.RecordBatch.from_pylist(want, schema=schema))
    rows.add("x", "", "", "language", None)
    assert rows.batch().num_rows == 1


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_equal_lines_are_aligned_as_by_the_table_of_weights(monkeypatch, cells):
    monkeypatch.setattr(G, "MAX_CELLS", cells)

    def slow(a: list[int], b: list[int], i0: int, j0: int) -> G.Grid:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (x == y))
        out, i, j = [], len(a), len(b)
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
            elif i and (not j or table[i - 1][j] > table[i][j - 1]):
                i -= 1
                out.append((i0 + i, -1))
            else:
                j -= 1
                out.append((-1, j0 + j))
        return out[::-1]

    pairs = texts(300, 40)
    fast = [G.align(a, b) for a, b in pairs]
    monkeypatch.setattr(G, "_equal_lines", slow)
    assert fast == [G.align(a, b) for a, b in pairs]
