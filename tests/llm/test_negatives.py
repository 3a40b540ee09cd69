import random

import pytest

from palimpsest.llm import negatives as N

SMALL = N.Mining(anchor_rows=3, block_rows=4, dims=2, cell_tiles=3)


def plain(rows, m=N.Mining()):
    """Every anchor against every row."""
    whole = [(i, label, [int(m.scale * x // 1) for x in v], a) for i, label, v, a in rows if label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for n, (anchor, label, v, is_anchor) in enumerate(whole):
        if is_anchor:
            scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, other == label) for k, (i, other, w, _) in enumerate(whole) if k != n]  # noqa: B905
            for s, none, i, _ in sorted(x for x in scored if x[3])[: m.positives]:
                fit = sorted(x for x in scored if not x[3] and -m.low * s <= -100 * x[0] <= -m.high * s)[: m.negatives]
                out += [(anchor, None if none else i, k, None if nn else j, -s, -t) for k, (t, nn, j, _) in enumerate(fit, 1)]
    return out


def check(spark, rows, m):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, is_anchor boolean, rank string")
    got = list(map(tuple, N.mine(table, m).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, m)))
    return got


@pytest.mark.parametrize("mining", [SMALL, N.Mining()])
def test_equals_all_pairs(spark, mining):
    draw = random.Random(3)
    rows = [(k, draw.choice([0, 0, 0, 1, 2]), [draw.uniform(0, 0.5) for _ in range(5)], k % 4 == 0) for k in range(60)]
    assert check(spark, rows, mining)


def test_cases(spark):
    """Null and non-finite components, ties, repeated rows, vectors of other lengths, many labels, no id."""
    one, far = [1.0, 0.5, 0.25], [0.75, 0.5, 0.0]
    rows = [(1, 0, one, True), (1, 0, one, True), (2, 0, one, False), (3, 0, one[:2], None), (None, 0, one, True), (4, 1, far, True), (5, 1, far, False), (6, 2, far, False), (None, 3, far, False), (7, 4, far + [1.0], False)]
    rows += [(8, None, one, True), (9, 0, None, True), (10, 0, [1.0, None, 1.0], True), (11, 1, [float("nan"), 1.0, 1.0], True), (12, 1, [float("inf"), 1.0, 1.0], True), (13, 1, [], True), (14, 1, [-1.0, -0.001, 0.0], True)]
    rows += [(20 + k, 10 + k, [0.7, 0.4 + k / 100, 0.0], k % 2 == 0) for k in range(12)]
    for m in (SMALL, N.Mining()):
        assert check(spark, rows, m)


def test_large_numbers(spark):
    """Beyond 2^53 products are whole numbers still; beyond 64 bits they are refused."""
    big = 1048576.0  # 2^28 after scaling
    rows = [(1, 0, [big, 1.0], True), (2, 0, [big, 1 / 256], False), (3, 1, [big / 2, 3 / 256], False), (4, 1, [big / 2, 5 / 256], False)]
    assert {r[4] for r in check(spark, rows, SMALL)} == {(1 << 56) + 256}
    with pytest.raises(Exception, match="64 bits"):
        N.mine(spark.createDataFrame([(1, 0, [1e9], True), (2, 0, [1e9], False)], "vec_id long, label int, embedding array<double>, is_anchor boolean")).collect()


def test_empty(spark):
    schema = "vec_id long, label int, embedding array<float>, is_anchor boolean"
    assert N.mine(spark.createDataFrame([], schema)).collect() == []
    assert N.mine(spark.createDataFrame([(1, 0, [1.0], False)], schema)).collect() == []
    assert N.mine(spark.createDataFrame([(1, 0, [1.0], True)], schema)).collect() == []
