"""Line-mode comparison of pairs: matching, alignment, actions, highlights, folds.

One row of a pair is the unit of work.  The order-dependent part (sequence
alignment) runs in ``align_pairs``; everything after it is relational.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread

#: Cells of the dynamic programme; above, unique lines cut the problem first.
MAX_CELLS = 1_000_000
#: Rows of context that stay visible around a change.
CONTEXT = 3


def _table(a: np.ndarray, b: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of all prefixes; ``above`` is the row that they go on from."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    if above is not None:
        table[0] = above
    for i, x in enumerate(a):
        # A row is the running maximum of the row above and of its diagonal steps.
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(b == x, table[i, :-1] + 1, 0)))
    return table


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matched positions; on the way back equal lines match first, then the longer side above.

    Of a table of more than ``MAX_CELLS`` cells only as many rows are kept as their
    square root says; those between are made again on the way back.
    """
    step = len(a) if len(a) * len(b) <= MAX_CELLS else math.isqrt(len(a)) + 1
    kept = [np.zeros(len(b) + 1, np.int32)]
    for k in range(0, len(a) - step, step):
        kept.append(_table(a[k : k + step], b, kept[-1])[-1].copy())
    i, j, out = len(a), len(b), []
    while kept:
        above = kept.pop()
        first = len(kept) * step
        if not (i and j):
            break
        table = _table(a[first:i], b[:j], above[: j + 1])
        while i > first and j:
            if a[i - 1] == b[j - 1]:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif table[i - 1 - first, j] >= table[i - first, j - 1]:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (in order of the first part) with a rising second part."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        back.append(at[place - 1] if place else -1)
        tails[place:place + 1] = [j]
        at[place:place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def match_lines(left: list[str], right: list[str], max_cells: float = MAX_CELLS) -> list[tuple[int, int]]:
    """Row pairs of equal lines, rising on both sides."""
    low = 0
    while low < min(len(left), len(right)) and left[low] == right[low]:
        low += 1
    high = 0
    while high < min(len(left), len(right)) - low and left[-1 - high] == right[-1 - high]:
        high += 1
    out = [(k, k) for k in range(low)]
    number: dict[str, int] = {}
    a = np.array([number.setdefault(x, len(number)) for x in left[low : len(left) - high]], np.int64)
    b = np.array([number.setdefault(x, len(number)) for x in right[low : len(right) - high]], np.int64)
    cuts = [(-1, -1)]
    if len(a) * len(b) > max_cells:
        ca, cb = Counter(a.tolist()), Counter(b.tolist())
        where = {x: j for j, x in enumerate(b.tolist()) if cb[x] == 1}
        cuts += increasing([(i, where[x]) for i, x in enumerate(a.tolist()) if ca[x] == 1 and x in where])
    cuts.append((len(a), len(b)))
    for (i, j), (m, n) in zip(cuts, cuts[1:], strict=False):
        if i >= 0:
            out.append((i + low, j + low))
        if 0 < (m - i - 1) * (n - j - 1) <= max_cells:
            out += [(i + 1 + low + p, j + 1 + low + q) for p, q in common_subsequence(a[i + 1 : m], b[j + 1 : n])]
    return out + [(len(left) - k, len(right) - k) for k in range(high, 0, -1)]


def align(left: str, right: str, max_cells: float = MAX_CELLS) -> list[tuple[int, int, bool]]:
    """Grid rows (left line, right line, equal); -1 is a filler.

    An empty side is all filler.  Lines between two matches are set side by
    side, and what is left over faces fillers.
    """
    a, b = left.split("\n"), right.split("\n")
    if not left:
        return [(-1, j, False) for j in range(len(b))]
    if not right:
        return [(i, -1, False) for i in range(len(a))]
    out, i, j = [], 0, 0
    for m, n in [*match_lines(a, b, max_cells), (len(a), len(b))]:
        for k in range(max(m - i, n - j)):
            out.append((i + k if i + k < m else -1, j + k if j + k < n else -1, False))
        if m < len(a):
            out.append((m, n, True))
        i, j = m + 1, n + 1
    return out


def align_pairs(pairs: DataFrame, max_cells: float = MAX_CELLS) -> DataFrame:
    """``pairs`` (a, b, src, dst) to grid rows (a, b, grid_row, left_line, right_line, equal).

    Gaps of more than ``max_cells`` cells between unique lines stay unmatched, as the format has it; with
    ``math.inf`` every gap is matched, in the time of its cells and the memory of some of their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = align(batch.column(2)[k].as_py() or "", batch.column(3)[k].as_py() or "", max_cells)
                at = pa.array([k] * len(rows), pa.int32())
                left, right, equal = zip(*rows, strict=True)
                columns = [pa.array(range(len(rows)), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(equal, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *columns], ["a", "b", "grid_row", "left_line", "right_line", "equal"]
                )

    return spread(pairs.select("a", "b", "src", "dst"), "a", "b").mapInArrow(run, "a long, b long, grid_row int, left_line int, right_line int, equal boolean")


def summary(grid: DataFrame) -> DataFrame:
    """Counts of equal, changed, deleted and inserted rows for each pair."""

    def rows(condition: str):
        return F.sum(F.when(F.expr(condition), 1).otherwise(0)).cast("long")

    return grid.groupBy("a", "b").agg(
        rows("equal").alias("equal_lines"),
        rows("NOT equal AND left_line >= 0 AND right_line >= 0").alias("changed_lines"),
        rows("right_line < 0").alias("deleted_lines"),
        rows("left_line < 0").alias("inserted_lines"),
    )


def actions(grid: DataFrame, mode: str = "compat") -> DataFrame:
    """Line actions in grid order.

    In ``compat`` mode lines set side by side give no action; ``full`` reports
    them as updates.
    """
    kind = F.when(F.col("right_line") < 0, "delete").when(F.col("left_line") < 0, "insert")
    if mode == "full":
        kind = kind.when(~F.col("equal"), "update")
    found = grid.withColumn("action", kind).where("action IS NOT NULL")
    order = Window.partitionBy("a", "b").orderBy("grid_row")
    return found.select("a", "b", (F.row_number().over(order) - 1).alias("seq"), "action", "left_line", "right_line")


def folds(rows: DataFrame, keys: list[str], row: str, changed: str, context: int = CONTEXT) -> DataFrame:
    """Runs of rows away from any change, longer than one row; all rows if nothing changed.

    ``rows`` has every row with a boolean ``changed``.
    """
    order = Window.partitionBy(*keys).orderBy(row)
    near = F.max(F.col(changed).cast("int")).over(order.rowsBetween(-context, context))
    hidden = rows.select(*keys, F.col(row).alias("_r"), near.alias("_n")).where("_n = 0")
    island = F.col("_r") - F.row_number().over(Window.partitionBy(*keys).orderBy("_r"))
    runs = hidden.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("_r").cast("long").alias("start_row"), F.max("_r").cast("long").alias("end_row"))
    return runs.where("end_row > start_row").drop("_i")


def next_change(rows: DataFrame, keys: list[str], row: str, changed: str) -> DataFrame:
    """For every row the next and the previous changed row, around the ends; null without any."""
    order = Window.partitionBy(*keys).orderBy(row)
    whole = Window.partitionBy(*keys)
    hit = F.when(F.col(changed), F.col(row))
    after = F.min(hit).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.max(hit).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        *keys, F.col(row).cast("long").alias("row"),
        F.coalesce(after, F.min(hit).over(whole)).cast("long").alias("next_row"), F.coalesce(before, F.max(hit).over(whole)).cast("long").alias("previous_row"),
    )
