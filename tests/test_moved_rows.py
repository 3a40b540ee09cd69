"""What queries move between tasks, and how they join, told by the engine's own counters."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import actionjoin as A
from palimpsest.operators import nodes as N
from palimpsest.operators import treejoin as J
from palimpsest.plans import registered

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ACTIONS = "key long, seq long, action string, node_id int, dest_id int, position int, old_value string, new_value string, subtree boolean"
NODES = "key long, node_id int, parent_id int, child_index int, pre_size int, type string, label string, start_row int, end_row int, is_keyword boolean"


def moved_rows(spark, run):
    """Rows that shuffles wrote while ``run`` ran."""

    def total():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


@needs_data
@pytest.mark.parametrize("name, share", [("planted_keywords", 0.5), ("planted_moves", 1), ("planted_deletes", 1.5)])
def test_words_stay_where_they_are(spark, name, share):
    """Of the nodes of a corpus, nearly all of them words, few are moved, and hardly any twice."""
    queries = registered()[0]
    nodes = queries["word_nodes"](spark, DATA).count()
    assert moved_rows(spark, lambda: queries[name](spark, DATA).collect()) < share * nodes


def test_brought_columns(spark):
    """Actions that bring the columns of their nodes give what others look up; a node that is not brought is looked up."""
    # Lines (1, 4) of two words each, the second of each line and its line being deleted or moved.
    nodes = spark.createDataFrame(
        [(1, 0, -1, -1, 7, "document", "", 0, 1, False), (1, 1, 0, 0, 3, "line", "", 0, 0, False), (1, 2, 1, 0, 1, "word", "a", 0, 0, False), (1, 3, 1, 1, 1, "word", "b", 0, 0, False),
         (1, 4, 0, 1, 3, "line", "", 1, 1, False), (1, 5, 4, 0, 1, "word", "c", 1, 1, False), (1, 6, 4, 1, 1, "word", "d", 1, 1, False)], NODES)
    rows = [(1, k, "delete", k, None, 0, None, None, False) for k in (1, 2, 3, 4, 6)] + [(1, 10 + k, "move", k, d, 0, None, None, False) for k, d in ((5, 2), (6, 2))]
    actions = spark.createDataFrame(rows, ACTIONS)

    def struct(alias, *columns):
        return nodes.select("key", F.col("node_id").alias(f"{alias}_id"), F.struct(*columns).alias(alias))

    own = struct("node", "parent_id", "pre_size", "type", "start_row", "label")
    brought = actions.join(own, ["key", "node_id"], "left").join(struct("dest", "parent_id"), ["key", "dest_id"], "left")
    for table in (actions, brought):
        folded = A.fold_subtrees(table, nodes, nodes, ["key"], ["line"])
        assert sorted((r.seq, r.subtree) for r in folded.collect()) == [(1, True), (4, False), (6, False), (15, False), (16, False)]
        named = A.name_groups(table, nodes, nodes, ["key"])
        assert sorted((r.seq, r.group_id) for r in named.collect() if r.group_id) == [(15, "group-1"), (16, "group-1")]
        assert named.count() == len(rows)


def test_totals_of_inner_nodes(spark):
    """A leaf counts at its parent even if it comes before or behind inner ones; a tree of one leaf has no inner node."""
    nodes = spark.createDataFrame([(1, 0, -1, 6), (1, 1, 0, 1), (1, 2, 0, 3), (1, 3, 2, 2), (1, 4, 3, 1), (1, 5, 0, 1), (2, 0, -1, 1)], "key long, node_id int, parent_id int, pre_size int")
    found = N.inner_totals(nodes, ["key"], {"n": F.lit(1), "ids": F.col("node_id")})
    assert sorted((r.key, r.node_id, r.parent_id, r.pre_size, r.n, r.ids) for r in found.collect()) == [(1, 0, -1, 6, 6, 15), (1, 2, 0, 3, 3, 9), (1, 3, 2, 2, 2, 7)]


@needs_data
@pytest.mark.parametrize("name", ["event_votes", "event_key_leaves", "event_mapped_hosts", "event_common"])
def test_nothing_is_broadcast(spark, name):
    """Tables of ids are small as files and large in memory, so no join of them goes through the driver."""
    plan = registered()[0][name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_expanded_in_stretches(spark):
    """A matched subtree gives all its nodes, whether it is one node, ends with a stretch or goes beyond it; without sizes they are looked up."""
    sizes = {1: 1, 2: 4096, 3: 4097, 4: 9000}
    roots = spark.createDataFrame([(k, 5, 7, n) for k, n in sizes.items()], "key long, src_id int, dst_id int, pre_size int")
    nodes = roots.select("key", F.col("src_id").alias("node_id"), "pre_size")
    for table in (roots, roots.drop("pre_size")):
        found = J.expanded(table, nodes, ["key"]).groupBy("key").agg(F.count_distinct("src_id").alias("n"), F.min("src_id").alias("a"), F.max("src_id").alias("b"), F.min(F.expr("dst_id - src_id")).alias("c"), F.max(F.expr("dst_id - src_id")).alias("d"))
        assert {r.key: tuple(r[1:]) for r in found.collect()} == {k: (n, 5, 4 + n, 2, 2) for k, n in sizes.items()}
