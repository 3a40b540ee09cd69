"""Binned joins and scans against loops, with bins far smaller than the documents."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import intervals as I
from palimpsest.operators import nodes as N


def tree(draw, n, key):
    """(key, node_id, parent_id, pre_size) of a random tree in pre-order."""
    parent = [-1]
    for k in range(1, n):
        # Any node on the path to the one before may be the parent.
        path, p = [], k - 1
        while p >= 0:
            path.append(p)
            p = parent[p]
        parent.append(draw.choice(path))
    size = [1] * n
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    return [(key, k, parent[k], size[k], draw.random() < 0.3) for k in range(n)]


def trees(spark):
    draw = random.Random(2)
    rows = tree(draw, 60, 1) + tree(draw, 1, 2) + tree(draw, 25, 3)
    return rows, spark.createDataFrame(rows, "key long, node_id int, parent_id int, pre_size int, is_keyword boolean")


def test_inside_and_overlapping(spark):
    draw = random.Random(1)
    points = [(draw.choice("ab"), draw.randrange(40)) for _ in range(50)]
    ranges = [(draw.choice("abc"), s := draw.randrange(40), s + draw.randrange(0, 30)) for _ in range(40)]
    p, r = spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(ranges, "k string, s int, e int")
    for width in (1, 7, 4096):
        got = sorted(map(tuple, I.inside(p, r, ["k"], "at", "s", "e", width).select("k", "at", "s", "e").collect()))
        assert got == sorted((k, x, s, e) for k, x in points for kk, s, e in ranges if k == kk and s <= x < e)
        other = r.toDF("k", "t", "f")
        got = sorted(map(tuple, I.overlapping(r, other, ["k"], ("s", "e"), ("t", "f"), width).select("k", "s", "e", "t", "f").collect()))
        assert got == sorted((k, s, e, t, f) for k, s, e in ranges for kk, t, f in ranges if k == kk and max(s, t) < min(e, f))


def test_running(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.randrange(30), draw.randrange(9)) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    for width in (1, 5, 4096):
        got = sorted(map(tuple, I.running(df, ["k"], "at", {"s": F.col("v")}, {"m": F.col("v")}, width).collect()), key=repr)
        before = [[x[2] for x in rows if x[0] == k and x[1] < at] for k, at, _ in rows]
        assert got == sorted(((*r, sum(b), max(b, default=None)) for r, b in zip(rows, before, strict=True)), key=repr)


def test_nested(spark):
    rows, df = trees(spark)
    chosen = [r for r in rows if r[4]]
    ends = df.where("is_keyword").withColumn("end", F.col("node_id") + F.col("pre_size"))
    for width in (3, 4096):
        got = sorted((r.key, r.node_id) for r in I.outermost(ends, ["key"], "node_id", "end", width).collect())
        assert got == sorted((k, n) for k, n, _, _, _ in chosen if not any(kk == k and m < n < m + s for kk, m, _, s, _ in chosen))
        got = {
            (r.key, r.node_id): r.host for r in I.enclosing(df, ends.select("key", F.col("node_id").alias("h"), "end"), ["key"], "node_id", "h", "end", width).collect()}
        assert got == {(k, n): max((m for kk, m, _, s, _ in chosen if kk == k and m < n < m + s), default=None) for k, n, _, _, _ in rows}


def test_subtree_sums(spark):
    rows, df = trees(spark)
    got = {(r.key, r.node_id): (r.n, r.w) for r in N.inner_sums(df, ["key"], {"n": F.lit(1), "w": F.col("node_id")}).collect()}
    assert got == {(k, n): (s, sum(range(n, n + s))) for k, n, _, s, _ in rows}
    inside = {(r.key, r.root_id, r.node_id) for r in N.descendants(df, df).collect()}
    assert inside == {(k, n, m) for k, n, _, s, _ in rows for m in range(n + 1, n + s)}
    found = {(r.key, r.node_id) for r in N.keyword_trees(df).collect()}
    assert found == {(k, n) for k, n, _, s, _ in rows if s > 1 and all(w for kk, m, _, t, w in rows if kk == k and n < m < n + s and t == 1)}


def test_one_large_document_is_many_keys(spark):
    """The join of one document's ids with its subtrees is dealt by bins: no task has more than a share of them."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(200_000).select(F.lit(1).alias("key"), F.col("id").cast("int").alias("node_id"))
        roots = spark.createDataFrame([(1, 0, 200_000), (1, 5, 10)], "key int, node_id int, pre_size int")
        sizes = [r["count"] for r in N.descendants(ids, roots).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 199_999 + 9 and len(sizes) == 4 and max(sizes) < 80_000
