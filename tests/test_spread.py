"""Rows dealt to tasks, and rows with very many partners."""

from pyspark.sql import functions as F

from palimpsest.operators import spread as S
from palimpsest.operators.linediff import align_pairs


def test_with_partner_gives_every_pair_once(spark):
    pairs = [(0, k) for k in range(1, 400)] + [(1, 2), (1, 2), (7, 8), (9, 9)]
    rows = spark.createDataFrame([(0, "hot"), (1, "one"), (7, None), (5, "unused")], "a long, text string")
    table = spark.createDataFrame(pairs, "a long, b long")
    got = sorted(map(tuple, S.with_partner(table, rows, "a", "b").select("a", "b", "text").collect()), key=repr)
    names = {0: "hot", 1: "one", 7: None}
    assert got == sorted(((a, b, names[a]) for a, b in pairs if a in names), key=repr)
    # The hot row's partners are dealt by copies of it.
    counts = table.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / S.PARTNERS).alias("n")).where("a = 0").first()
    assert counts.n == 7


def test_kernels_use_all_tasks(spark):
    """However small the pairs, they are not put into one task."""
    pairs = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("x\ny").alias("src"), F.lit("x\nz").alias("dst"))
    grid = align_pairs(pairs)
    assert grid.count() == 400 and grid.select(F.spark_partition_id().alias("p")).distinct().count() >= 6
