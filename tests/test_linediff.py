import random

import pytest

from palimpsest.operators import linediff as D


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_matches_are_a_longest_common_subsequence(seed):
    pick = random.Random(seed)
    a, b = ([pick.choice("abcde") for _ in range(pick.randrange(0, 25))] for _ in range(2))
    found = D.match_lines(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert len(found) == lcs_length(a, b)


def test_large_inputs_fall_back_to_unique_lines():
    a = [str(k) for k in range(60)]
    b = a[:20] + ["new"] + a[20:50] + ["end"]
    assert D.match_lines(a, b, max_cells=10) == [(k, k) for k in range(20)] + [(k, k + 1) for k in range(20, 50)]


def test_increasing():
    assert D.increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]
    assert D.increasing([]) == []


@pytest.mark.parametrize("seed", range(20))
def test_alignment_covers_each_line_once(seed):
    pick = random.Random(seed)
    left, right = ("\n".join(pick.choice("abc") for _ in range(pick.randrange(1, 12))) for _ in range(2))
    grid = D.align(left, right)
    assert [r[0] for r in grid if r[0] >= 0] == list(range(left.count("\n") + 1))
    assert [r[1] for r in grid if r[1] >= 0] == list(range(right.count("\n") + 1))


def test_empty_sides():
    assert D.align("", "") == [(-1, 0, False)]
    assert D.align("", "a\nb") == [(-1, 0, False), (-1, 1, False)]
    assert D.align("a", "") == [(0, -1, False)]
    assert D.align("a\nb", "a\nb") == [(0, 0, True), (1, 1, True)]


def test_actions_and_folds(spark):
    text = "\n".join(f"line {k}" for k in range(20))
    other = text.replace("line 10", "line ten") + "\nmore"
    grid = D.align_pairs(spark.createDataFrame([(1, 2, text, other), (3, 4, text, text)], "a long, b long, src string, dst string"))
    assert [(r.a, r.action, r.right_line) for r in D.actions(grid).collect()] == [(1, "insert", 20)]
    assert sorted((r.action, r.right_line) for r in D.actions(grid, "full").collect()) == [("insert", 20), ("update", 10)]
    rows = grid.selectExpr("a", "grid_row", "NOT equal AS changed")
    assert sorted((r.a, r.start_row, r.end_row) for r in D.folds(rows, ["a"], "grid_row", "changed").collect()) == [(1, 0, 6), (1, 14, 16), (3, 0, 19)]
