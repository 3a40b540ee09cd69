"""Weighted rendezvous hashing of stable record keys over shards (native).

Every (key, shard) pair gets a pseudo-random number ``u`` in (0, 1) from
``xxhash64``; the record goes to the shard with the largest
``-weight / ln(u)``.  The chance of a shard is its share of the weights, and
a new shard only takes records into itself, because the scores of the old
shards do not change.

Cases: a null key is a key like any other; null text counts as empty; repeated
rows get the same shard and different slots, of which it does not matter who has
which; equal scores go to the larger shard number; a very long text is read once
for its size and checksum; an empty table gives no rows.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """Shard number of ``key`` among ``len(weights)`` shards; weights > 0."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scored = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{salt}:{shard}"), key), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        scored.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("s"), F.lit(shard).alias("n")))
    return F.array_max(F.array(*scored)).getField("n") if len(scored) > 1 else F.lit(0)


def shard_records(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 40,
    grown_weight: float = 1.0,
    overhead: int = 16,
    buckets: int = 64,
) -> DataFrame:
    """Shard, gapless slot and the shard after growth for every record.

    Equal records of one input partition are one run with a count.  Runs are
    numbered in two levels, so that no task holds a whole shard: inside ``buckets``
    hash buckets of each shard, and by bucket starts from a table of
    ``len(weights) * buckets`` counts, which is broadcast because its size does
    not depend on the data.  Then runs are dealt out evenly and become rows
    again, so a record that repeats a million times burdens no single task.
    The text never crosses a shuffle: only its size and checksum do.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).select(
        "*",
        rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("_bucket"),
        F.spark_partition_id().alias("_part"),
    )
    narrow = materialize(narrow, "shard-rows")
    counts = narrow.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    runs = narrow.groupBy("shard", "_bucket", "doc_id", "text_crc32", "size", "grown_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size", "_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    runs = runs.join(F.broadcast(starts), ["shard", "_bucket"])
    runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("_start") + F.col("_at"), F.col("_start") + F.col("_at") + F.col("_n") - 1)).alias("slot"),
        "grown_shard",
    )
