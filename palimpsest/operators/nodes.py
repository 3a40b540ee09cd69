"""Relational operators over a table of nodes (pre-order ids): containment, ancestors, label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import large
from . import intervals as I


def _ranges(roots: DataFrame, keys: list[str], first: int = 0) -> DataFrame:
    """(keys, root_id, _from, _to): the ids of subtrees of (keys, node_id, pre_size), without the first ``first`` of each."""
    return roots.select(*keys, F.col("node_id").alias("root_id"), (F.col("node_id") + first).alias("_from"), (F.col("node_id") + F.col("pre_size")).alias("_to"))


def descendants(nodes: DataFrame, roots: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keys, root_id, node_id): nodes strictly inside each of ``roots`` (keys, node_id, pre_size).

    Pre-order makes containment a range, and ids meet ranges by bins.
    """
    found = I.inside(nodes.select(*keys, "node_id"), _ranges(roots, [*keys], 1), [*keys], "node_id", "_from", "_to")
    return found.select(*keys, "root_id", "node_id")


def inner_sums(nodes: DataFrame, keys: list[str], sums: dict) -> DataFrame:
    """(keys, node_id, sums): of whole trees, the sums of columns over each subtree, its root included.

    A subtree is a stretch of pre-order ids, so its sum is the difference of two
    running sums: two equality joins, whatever the depth.
    """
    names = list(sums)
    before = I.running(nodes.select(*keys, "node_id", "pre_size", *(c.alias(f"_v_{n}") for n, c in sums.items())), keys, "node_id", {n: F.col(f"_v_{n}") for n in names})
    total = before.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names))
    after = before.select(*keys, F.col("node_id").alias("_next"), *(F.col(n).alias(f"_a_{n}") for n in names))
    rows = before.withColumn("_next", F.col("node_id") + F.col("pre_size")).join(large(after), [*keys, "_next"], "left").join(large(total), keys)
    return rows.select(*keys, "node_id", *((F.coalesce(f"_a_{n}", f"_t_{n}") - F.col(n)).alias(n) for n in names))


def inner_totals(nodes: DataFrame, keys: list[str], sums: dict) -> DataFrame:
    """(keys, node_id, parent_id, pre_size, sums): the sums of columns over the subtree of each inner node among ``nodes``.

    Leaves are added up at their parents before anything moves, so what is shuffled are inner nodes;
    a leaf counts where its parent is among ``nodes``.  Each inner node then asks for the running sums at both ends of its stretch.
    """
    names = list(sums)
    tall = F.col("pre_size") > 1
    own = nodes.select(*keys, F.when(tall, F.col("node_id")).otherwise(F.col("parent_id")).alias("_at"), F.when(tall, F.col("parent_id")).alias("_p"), F.when(tall, F.col("pre_size")).alias("_size"), *(c.alias(f"_v_{n}") for n, c in sums.items()))
    inner = own.groupBy(*keys, "_at").agg(F.max("_p").alias("_p"), F.max("_size").alias("_size"), *(F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names)).where("_size IS NOT NULL")
    ends = [F.struct(F.lit(-1).alias("_sign"), F.col("_at").alias("_place"), *(F.col(f"_v_{n}") for n in names)), F.struct(F.lit(1).alias("_sign"), (F.col("_at") + F.col("_size")).alias("_place"), *(F.lit(0).cast("long").alias(f"_v_{n}") for n in names))]
    points = inner.select(*keys, "_at", "_p", "_size", F.inline(F.array(*ends)))
    before = I.running(points, keys, "_place", {n: F.col(f"_v_{n}") for n in names})
    found = before.groupBy(*keys, "_at", "_p", "_size").agg(*(F.sum(F.col("_sign") * F.col(n)).alias(n) for n in names))
    return found.select(*keys, F.col("_at").alias("node_id"), F.col("_p").alias("parent_id"), F.col("_size").alias("pre_size"), *names)


def leaf_labels(nodes: DataFrame) -> DataFrame:
    """Multiset of leaf labels of each document."""
    return nodes.where("pre_size = 1 AND label != ''").groupBy("key", "type", "label").agg(F.count(F.lit(1)).alias("n"))


def nearest_ancestor(nodes: DataFrame, wanted: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keys, node_id, ancestor_id): deepest ancestor that meets the condition ``wanted``; null without one."""
    hosts = nodes.where(wanted).where("pre_size > 1").select(*keys, F.col("node_id").alias("_h"), (F.col("node_id") + F.col("pre_size")).alias("_to"))
    found = I.enclosing(nodes, hosts, [*keys], "node_id", "_h", "_to")
    return found.select(*keys, "node_id", F.col("host").alias("ancestor_id"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves, and the greatest depth and height for each document and type."""
    return nodes.groupBy("key", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pre_size") == 1).alias("n_leaves"),
        F.max("depth").alias("max_depth"),
        F.max("height").alias("max_height"),
    )


def repeated_subtrees(nodes: DataFrame, min_height: int = 2) -> DataFrame:
    """Equal subtrees: one row for each hash with the number of places and of documents."""
    tall = nodes.where(F.col("height") >= min_height)
    held = tall.groupBy("h_full", "key").agg(F.count(F.lit(1)).alias("n"), F.max("pre_size").alias("pre_size"), F.min("type").alias("type"))
    return held.groupBy("h_full").agg(
        F.sum("n").alias("places"), F.count("key").alias("documents"), F.max("pre_size").alias("pre_size"), F.min("type").alias("type")
    ).where("places > 1")


def label_frequency(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root_id, label, n): how often each label occurs in the subtrees of ``roots`` (key, node_id, pre_size), the root included."""
    found = I.inside(nodes.where("label != ''").select("key", "node_id", "label"), _ranges(roots, ["key"]), ["key"], "node_id", "_from", "_to")
    return found.groupBy("key", "root_id", "label").agg(F.count(F.lit(1)).alias("n"))


def label_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, n): of two tables of :func:`label_frequency` with (a, b, label, n), the sum of the right counts of labels on the left."""
    return left.select("a", "b", "label").distinct().join(large(right), ["a", "b", "label"]).groupBy("a", "b").agg(F.sum("n").alias("n"))


def leaf_dice(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, dice): Dice coefficient of two label multisets (a, b, label, n), of labels with a word character."""
    sides = [side.where(F.col("label").rlike("[A-Za-z0-9_]")).select("a", "b", "label", F.col("n").alias(f"n{k}")) for k, side in enumerate((left, right))]
    both = sides[0].join(large(sides[1]), ["a", "b", "label"], "full").groupBy("a", "b").agg(
        F.sum(F.least(F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0)))).alias("shared"), F.sum(F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("total")
    )
    return both.select("a", "b", F.round(2.0 * F.col("shared") / F.col("total"), 6).alias("dice"))


def keyword_trees(nodes: DataFrame) -> DataFrame:
    """(key, node_id): inner nodes of whole trees whose leaves are all keywords."""
    other = F.when((F.col("pre_size") == 1) & ~F.col("is_keyword"), 1).otherwise(0)
    if "parent_id" in nodes.columns:
        return inner_totals(nodes, ["key"], {"_other": other}).where("_other = 0").select("key", "node_id")
    found = inner_sums(nodes, ["key"], {"_n": F.lit(1), "_other": other})
    return found.where("_n > 1 AND _other = 0").select("key", "node_id")


def untouched(nodes: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` (keys, node_id, start_row, end_row) with ``other_row``: the partner of the first row if all rows have partners one after the other, else null.

    ``matches`` has (keys, row, other): rows that are equal on both sides, each once.
    """
    ranges = nodes.select(*keys, "node_id", "start_row", "end_row", (F.col("end_row") + 1).alias("_to"))
    held = I.inside(matches.select(*keys, "row", "other"), ranges, keys, "row", "start_row", "_to")
    offset = F.col("other") - F.col("row")
    whole = (F.count("row") == F.col("end_row") - F.col("start_row") + 1) & (F.min(offset) == F.max(offset))
    found = held.groupBy(*keys, "node_id", "start_row", "end_row").agg(F.when(whole, F.min("other")).alias("other_row"))
    return nodes.select(*keys, "node_id", "start_row", "end_row").join(large(found), [*keys, "node_id", "start_row", "end_row"], "left")


def may_match(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, src_id, dst_id) that the rows allow: untouched with untouched at their partners, edited with edited."""
    a = left.select(*keys, F.col("node_id").alias("src_id"), F.col("start_row").alias("_sr"), F.col("other_row").alias("_so"))
    b = right.select(*keys, F.col("node_id").alias("dst_id"), F.col("start_row").alias("_dr"), F.col("other_row").alias("_do"))
    both = pairs.join(large(a), [*keys, "src_id"]).join(large(b), [*keys, "dst_id"])
    same = F.col("_so").isNotNull() & F.col("_do").isNotNull() & (F.col("_so") == F.col("_dr")) & (F.col("_do") == F.col("_sr"))
    return both.where(same | F.col("_so").isNull() & F.col("_do").isNull()).select(*keys, "src_id", "dst_id")


def declaration_partners(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id): declarations (keys, node_id, type, name, receiver, pre_size) of one name and receiver.

    The destination must be the only one of its key; of several sources of its
    type the one of the nearest size is taken, then the first.
    """
    key = [*keys, "name", "receiver"]
    single = right.where("name != ''").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("node_id").alias("dst_id"), F.min("type").alias("type"), F.min("pre_size").alias("_size")).where("_n = 1")
    both = left.where("name != ''").join(large(single), [*key, "type"])
    return both.groupBy(*keys, "dst_id").agg(F.min_by("node_id", F.struct(F.abs(F.col("pre_size") - F.col("_size")), "node_id")).alias("src_id")).select(*keys, "src_id", "dst_id")


def outermost(actions: DataFrame, nodes: DataFrame, keys: list[str], wrappers: list[str]) -> DataFrame:
    """``actions`` (keys, node_id, ...) without those of wrappers whose parent has one too."""
    own = nodes.select(*keys, "node_id", "parent_id", "type")
    hosts = actions.select(*keys, F.col("node_id").alias("parent_id"), F.lit(True).alias("_host"))
    rows = actions.join(large(own), [*keys, "node_id"], "left").join(large(hosts.distinct()), [*keys, "parent_id"], "left")
    return rows.where(~(F.col("type").isin(*wrappers) & F.coalesce("_host", F.lit(False)))).select(*actions.columns)
