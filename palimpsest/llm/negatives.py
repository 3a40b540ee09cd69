"""Hard negatives of anchors by a blocked matrix product of their vectors with all rows.

The rows are sorted by label and cut into blocks.  A block of anchors and a block
of rows meet in one cell of a grid, where their product is added up over chunks of
dimensions to a tile of scores, and the tile is at once reduced to the few rows
it can give to the result.  Nothing but such rows leaves a tile, so what is moved
and the number of tasks follow the rows and not the scores:

1. tiles that can hold pairs of one label give the best positives of each anchor;
2. tiles that can hold pairs of different labels get the windows of scores that
   follow from the positives, and give the best negatives of each window.

Scores are whole numbers and exact: a product is taken in doubles where its
bound lies below 2^53, else in 64-bit integers; a score that could leave 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released

#: Stands for a negated score that does not count; a real one is never so large.
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """What is mined, and how the product is cut."""

    positives: int = 5
    negatives: int = 3
    #: A negative of a positive with score s has a score from ``low`` to ``high`` hundredths of s.
    low: int = 50
    high: int = 95
    #: Components become floor(scale * x).
    scale: int = 256
    anchor_rows: int = 256
    block_rows: int = 1024
    dims: int = 32
    #: Pairs of blocks that meet in one cell of the grid; the more, the fewer copies of blocks.
    cell_tiles: int = 256


_BLOCK = "block long, n int, width int, low long, high long, ids binary, labels binary, rows binary, cells binary"
_WINDOWS = "array<struct<i:int,r:int,id:bigint,score:bigint>>"
_POSITIVE = "a_block long, i int, a_row long, anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "a_row long, anchor_id long, r int, positive_id long, positive_score long, negative_id long, negative_score long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _whole(vectors: DataFrame) -> DataFrame:
    """Rows that take part, with a number of their own; those without an id get a negative one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = F.monotonically_increasing_id()
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"),
        F.when(F.col("vec_id").isNull(), -1 - own).otherwise(own).alias("row"),
    )


def blocks(rows: DataFrame, size: int, mining: Mining) -> DataFrame:
    """One row for each block of at most ``size`` consecutive rows; shorter vectors end in zeros, and components are kept as small as they fit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            vectors = batch.column("embedding")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(mining.scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if flat.size and np.abs(flat).max() >= 2.0**62:
                raise OverflowError("a component is too large for scores of 64 bits")
            width = max(1, int(lengths.max(initial=0)))
            grid = np.zeros((batch.num_rows, width), np.int64)
            grid[np.arange(width) < lengths[:, None]] = flat.astype(np.int64)
            labels = batch.column("label").to_numpy()
            ids = batch.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            most = max(-int(grid.min(initial=0)), int(grid.max(initial=0)))
            kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
            whole = [x.tobytes() for x in (ids, labels, batch.column("row").to_numpy(), grid.astype(kind))]
            number, made = part + made, made + 1
            out = (number, batch.num_rows, width, int(labels.min()), int(labels.max()), *whole)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], _names(_BLOCK))

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                every = pa.concat_batches(held)
                yield block(every.slice(0, size))
                held = [every.slice(size)]
        every = pa.concat_batches(held) if held else None
        if every is not None and every.num_rows:
            yield block(every)

    return rows.mapInArrow(released(cut), _BLOCK)


def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """a times b transposed, and a bound of its sizes."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64), bound
    if bound >= 2.0**62:
        raise OverflowError("a score could leave 64 bits")
    return a @ b.T, bound


def _tiles(a: DataFrame, b: DataFrame, n_a: int, n_b: int, mining: Mining, which: F.Column, schema: str, reduce) -> DataFrame:
    """Tiles of all pairs of blocks for which ``which`` holds; ``reduce`` turns each into rows of ``schema``.

    On a grid of p x q cells a block of anchors goes to the q cells of its row and
    a block of rows to the p cells of its column; there are cells enough for all tasks.
    """
    cells = min(max(1, n_a * n_b), max(ceil(n_a * n_b / mining.cell_tiles), 4 * a.sparkSession.sparkContext.defaultParallelism))
    p = min(max(1, round(sqrt(cells * n_a / max(1, n_b)))), max(1, n_a))
    q = min(max(1, ceil(cells / p)), max(1, n_b))
    spread = a.select(*(F.col(c).alias(f"a_{c}") for c in _names(_BLOCK)), "windows", F.pmod(F.xxhash64("block"), F.lit(p)).alias("p"), F.explode(F.expr(f"sequence(0L, {q - 1}L)")).alias("q"))
    rest = b.select(*(F.col(c).alias(f"b_{c}") for c in _names(_BLOCK)), F.pmod(F.xxhash64("block"), F.lit(q)).alias("q"), F.explode(F.expr(f"sequence(0L, {p - 1}L)")).alias("p"))
    met = spread.join(rest, ["p", "q"]).where(which)
    met = met.select("a_block", *(f"{s}_{c}" for s in "ab" for c in ("n", "width", "ids", "labels", "rows", "cells")), "windows")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                columns = reduce(scores(*(_cells(row, s) for s in "ab"), mining.dims), Tile.of(row))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("i", "r") else pa.int64()) for n, c in zip(_names(schema), columns, strict=True)], _names(schema))

    return met.mapInArrow(released(multiply), schema)


def _cells(row: pa.RecordBatch, side: str) -> np.ndarray:
    """The components of a block, whatever their size in bytes."""
    raw, n = row.column(f"{side}_cells")[0].as_buffer(), row.column(f"{side}_n")[0].as_py()
    width = int(row.column(f"{side}_width")[0].as_py())
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[raw.size // (n * width)]).reshape(n, width)


def scores(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    """All scores of two blocks, added up over chunks of ``dims`` dimensions."""
    total, bound = np.zeros((len(a), len(b)), np.int64), 0.0
    for at in range(0, min(a.shape[1], b.shape[1]), dims):  # shorter vectors end in zeros
        end = min(at + dims, a.shape[1], b.shape[1])
        part, least = product(a[:, at:end].astype(np.int64), b[:, at:end].astype(np.int64))
        total += part
        bound += least
        if bound >= 2.0**62:
            raise OverflowError("a score could leave 64 bits")
    return total


@dataclass
class Tile:
    """What a finished tile knows of its rows and columns."""

    block: int
    a_ids: np.ndarray
    a_labels: np.ndarray
    a_rows: np.ndarray
    b_ids: np.ndarray
    b_labels: np.ndarray
    b_rows: np.ndarray
    windows: list[dict]

    @classmethod
    def of(cls, row: pa.RecordBatch) -> Tile:
        numbers = [np.frombuffer(row.column(f"{s}_{c}")[0].as_py(), np.int64) for s in "ab" for c in ("ids", "labels", "rows")]
        return cls(row.column("a_block")[0].as_py(), *numbers, row.column("windows")[0].as_py() or [])

    def ranked(self, scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of each row, the best first and ties by id, with their negated scores; ``NONE`` at the end for those not allowed."""
        by_id = np.lexsort((self.b_ids, self.b_rows < 0))
        costs = np.where(allowed, -scores, NONE)[:, by_id]
        order = np.argsort(costs, axis=1, kind="stable")
        return by_id[order], np.take_along_axis(costs, order, 1)


def _named(ids: np.ndarray, rows: np.ndarray) -> list:
    return [None if r < 0 else int(i) for i, r in zip(ids.tolist(), rows.tolist(), strict=True)]


def mine(vectors: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding, is_anchor).

    Rows with a null label or vector, or with a component that is null or not
    finite, take no part; a vector shorter than another counts as ending in
    zeros, an empty one scores 0.  Rows are told apart by themselves and not by
    their ids: repeated rows are neighbours of each other, and each repeated anchor gives its
    rows.  A row without an id ranks behind rows of its score.  An anchor
    without positives, and a positive without negatives in its window, gives no row.
    Further columns are left out.
    """
    spark = vectors.sparkSession
    rows = _whole(vectors).repartitionByRange(F.col("label"), F.col("vec_id"), F.col("row")).sortWithinPartitions("label", "vec_id", "row")
    rows = materialize(rows, "negatives-rows")
    b = materialize(blocks(rows, mining.block_rows, mining), "negatives-blocks")
    a = materialize(blocks(rows.where("is_anchor").coalesce(max(1, spark.sparkContext.defaultParallelism)), mining.anchor_rows, mining), "negatives-anchors")
    n_a, n_b = a.count(), b.count()

    def positives(scores: np.ndarray, t: Tile) -> list[list]:
        order, costs = t.ranked(scores, (t.a_labels[:, None] == t.b_labels[None, :]) & (t.a_rows[:, None] != t.b_rows[None, :]))
        i, k = np.nonzero(costs[:, : mining.positives] != NONE)
        j = order[i, k]
        return [[t.block] * len(i), i.tolist(), t.a_rows[i].tolist(), _named(t.a_ids[i], t.a_rows[i]), _named(t.b_ids[j], t.b_rows[j]), (-costs[i, k]).tolist()]

    def negatives(scores: np.ndarray, t: Tile) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        order, costs = t.ranked(scores, t.a_labels[:, None] != t.b_labels[None, :])
        for w in t.windows:
            i, s = w["i"], w["score"]
            least, most = -(-mining.low * s // 100), mining.high * s // 100
            at = np.searchsorted(costs[i], -most, "left")
            for k in range(at, min(at + mining.negatives, np.searchsorted(costs[i], -least, "right"))):
                j = order[i, k]
                row = (int(t.a_rows[i]), None if t.a_rows[i] < 0 else int(t.a_ids[i]), w["r"], w["id"], s, None if t.b_rows[j] < 0 else int(t.b_ids[j]), -int(costs[i, k]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return out

    bare = a.withColumn("windows", F.lit(None).cast(_WINDOWS))
    alike = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    best = _tiles(bare, b, n_a, n_b, mining, alike, _POSITIVE, positives)
    place = Window.partitionBy("a_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    best = best.withColumn("r", F.row_number().over(place)).where(F.col("r") <= mining.positives)
    windows = best.groupBy("a_block").agg(F.collect_list(F.struct("i", "r", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("windows"))
    windows = materialize(windows, "negatives-windows")
    asked = a.join(windows.withColumnRenamed("a_block", "block"), "block")

    other = ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low")))
    found = _tiles(asked, b, n_a, n_b, mining, other, _NEGATIVE, negatives)
    order = Window.partitionBy("a_row", "r").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
