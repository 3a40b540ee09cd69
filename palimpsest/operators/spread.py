"""Dealing rows to tasks by what they cost, where their bytes say too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partners of a row that share one copy of it.
PARTNERS = 64


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` dealt by a hash of ``keys`` to as many tasks as keep all cores busy twice over.

    Kernels cost far more for a byte than a scan or a join, so the sizes that
    adaptive execution goes by would put all of a small table in one task; a number of partitions that is asked for stays.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def with_partner(pairs: DataFrame, rows: DataFrame, key: str, other: str) -> DataFrame:
    """``pairs`` joined with ``rows`` by ``key``, where one row may have very many partners.

    Such a row is copied once for every 64 of its partners, and each copy
    meets its share of them by a hash of ``other``, so no task gets all.
    """
    counts = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_copies"))
    asked = pairs.join(counts, key).withColumn("_copy", F.pmod(F.xxhash64(other), F.col("_copies")).cast("int"))
    held = rows.join(counts, key).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return asked.drop("_copies").join(held.drop("_copies"), [key, "_copy"]).drop("_copy")
