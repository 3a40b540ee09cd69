"""Byte spans of a text: their lines and columns, pieces per line, and merged runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I


def line_pieces(spans: DataFrame, offsets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans (key, start_byte, end_byte) cut at line ends, without the newline; empty pieces are dropped.

    ``offsets`` has (key, line_no, start_byte, n_bytes).
    """
    rows = offsets.select(key, "line_no", F.col("start_byte").alias("_from"), (F.col("start_byte") + F.col("n_bytes")).alias("_to"))
    pieces = I.overlapping(spans.select(key, "start_byte", "end_byte"), rows, [key], ("start_byte", "end_byte"), ("_from", "_to"))
    low, high = F.greatest("start_byte", "_from"), F.least("end_byte", "_to")
    return pieces.select(
        key, "start_byte", "end_byte", F.col("line_no").cast("long").alias("line_no"), (low - F.col("_from")).alias("start_col"), (high - F.col("_from")).alias("end_col")
    )


def merge_spans(spans: DataFrame, keys: list[str], start: str, end: str, gap: int = 3) -> DataFrame:
    """Spans that overlap or lie at most ``gap`` apart become one."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    run = F.sum("_new").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.select(*keys, F.col(start).alias(start), F.col(end).alias(end), fresh.alias("_new")).withColumn("_run", run)
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_run")
