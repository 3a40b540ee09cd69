"""Joins of points and ranges, and running values, over places of a document (pre-order ids, rows or bytes).

Places are cut into bins of ``width``, and rows meet by (keys, bin): a single large
document is many keys, and so spreads over all tasks.  Ranges are half-open and
never negative; a range without a place holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import large

#: Places of a bin; a range costs a row for each bin it touches.
WIDTH = 4096


def _bins(low: Column, high: Column, width: int) -> Column:
    """Bins that the places from ``low`` to before ``high`` touch."""
    first, last = F.floor(low / width).cast("long"), F.floor((high - 1) / width).cast("long")
    return F.explode(F.when(low < high, F.sequence(first, last)))


def inside(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """``points`` (keys, at, ...) with every one of ``ranges`` (keys, start, end, ...) that holds them; other column names must differ."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    r = ranges.select("*", _bins(F.col(start), F.col(end), width).alias("_bin"))
    return p.join(large(r), [*keys, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of ranges of two tables that share a place; a pair meets in the first bin of both and counts there."""
    (a, b), (c, d) = left_range, right_range
    x = left.select("*", _bins(F.col(a), F.col(b), width).alias("_bin"))
    y = right.select("*", _bins(F.col(c), F.col(d), width).alias("_bin"))
    first = F.floor(F.greatest(F.col(a), F.col(c)) / width).cast("long")
    return x.join(large(y), [*keys, "_bin"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_bin") == first)).drop("_bin")


def running(rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """``rows`` with sums and maxima over the rows before them, by ``at``; equal places share none of each other's.

    Two steps: whole bins first, whose few values are carried along the
    document, then the rows of a bin.  Without rows before, a sum is 0 and a maximum null.
    """
    sums, maxima = sums or {}, maxima or {}
    binned = rows.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    whole = binned.groupBy(*keys, "_bin").agg(*(F.sum(c).alias(f"_b_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_b_{n}") for n, c in maxima.items()))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_bin", *(F.sum(f"_b_{n}").over(over).alias(f"_b_{n}") for n in sums), *(F.max(f"_b_{n}").over(over).alias(f"_b_{n}") for n in maxima))
    near = Window.partitionBy(*keys, "_bin").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    own = binned.withColumns({**{f"_o_{n}": F.sum(c).over(near) for n, c in sums.items()}, **{f"_o_{n}": F.max(c).over(near) for n, c in maxima.items()}})
    zero = F.lit(0)
    found = own.join(large(whole), [*keys, "_bin"])
    return found.select(
        *(F.col(c) for c in rows.columns),
        *((F.coalesce(f"_b_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in sums),
        *(F.greatest(f"_b_{n}", f"_o_{n}").alias(n) for n in maxima),
    )


def outermost(ranges: DataFrame, keys: list[str], start: str, end: str, width: int = WIDTH) -> DataFrame:
    """Those of nested ranges (subtrees of one tree) that lie in no other one; equal starts must not occur."""
    found = running(ranges, keys, start, maxima={"_reach": F.col(end)}, width=width)
    return found.where(F.col("_reach").isNull() | (F.col("_reach") <= F.col(start))).drop("_reach")


def enclosing(points: DataFrame, hosts: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """(keys, at, host): the innermost of nested ``hosts`` that begins before a point and reaches beyond it; null without one.

    ``points`` must not repeat.
    """
    near = hosts.select(*keys, F.col(start).alias("host"), F.col(end).alias("_end"))
    found = inside(points.select(*keys, at), near.withColumn("_from", F.col("host") + 1), keys, at, "_from", "_end", width)
    best = found.groupBy(*keys, at).agg(F.max("host").alias("host"))
    return points.select(*keys, at).join(large(best), [*keys, at], "left")
