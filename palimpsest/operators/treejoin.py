"""Matching of trees as joins over node tables, for pairs of any size.

``left`` and ``right`` are node tables with the columns of the pair (``keys``)
and node_id, parent_id, child_index, depth, height, pre_size, type, label and h_full; a mapping has
(keys, src_id, dst_id).  Subtrees are stretches of pre-order ids, so everything that
asks what lies inside what meets by bins (``intervals``), and a pair of
millions of nodes is many keys.  Steps that build on each other are written
in between (``tables.written``); their number grows with how deep equal
subtrees are hidden in others, and not with the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import large, written
from . import intervals as I

# Fixed values of the method.
MIN_HEIGHT = 2
MIN_DICE = 0.5
TOLERANCE = 0.05
LEAF_DEPTH = 2
LEAF_DICE = 0.25


def _shared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h_full, n_left, n_right) of the hashes on both sides."""
    counts = [side.groupBy(*keys, "h_full").agg(F.count(F.lit(1)).alias(f"n_{name}")) for side, name in ((left, "left"), (right, "right"))]
    return counts[0].join(large(counts[1]), [*keys, "h_full"])


def _uncovered(nodes: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` that are in none of the subtrees of ``roots`` (keys, node_id, _end), roots included."""
    held = I.inside(nodes.select(*keys, "node_id"), roots.select(*keys, F.col("node_id").alias("_root"), "_end"), keys, "node_id", "_root", "_end")
    return nodes.join(large(held.select(*keys, "node_id")), [*keys, "node_id"], "left_anti")


def equal_subtrees(left: DataFrame, right: DataFrame, keys: list[str], min_height: int = MIN_HEIGHT) -> DataFrame:
    """(keys, side, node_id, pre_size, h_full, unique): the largest subtrees that are equal on both sides.

    What a walk by height takes from the tallest down, without a step for each
    height: of the nodes whose hash is on both sides, a hash is settled once none
    of its nodes lies in another such node.  Settled subtrees leave the rest with all inside
    them, and nodes whose hash has lost its other side leave as well.  A settled hash with one node
    on each side is ``unique``.
    """
    rest = [written(side.where(F.col("height") >= min_height).select(*keys, "node_id", "pre_size", F.expr("node_id + pre_size AS _end"), "h_full"), "treejoin-nodes") for side in (left, right)]
    found = None
    while True:
        both = _shared(*rest, keys)
        rest = [written(side.join(large(both.select(*keys, "h_full")), [*keys, "h_full"], "left_semi"), "treejoin-shared") for side in rest]
        if not rest[0].head(1):
            break
        tops = [I.outermost(side, keys, "node_id", "_end") for side in rest]
        hidden = [side.join(large(top.select(*keys, "node_id")), [*keys, "node_id"], "left_anti").select(*keys, "h_full") for side, top in zip(rest, tops, strict=True)]
        hidden = hidden[0].unionByName(hidden[1]).distinct()
        settled = _shared(*rest, keys).join(large(hidden), [*keys, "h_full"], "left_anti").withColumn("unique", F.expr("n_left = 1 AND n_right = 1"))
        settled = written(settled.select(*keys, "h_full", "unique"), "treejoin-settled")
        roots = [side.join(large(settled), [*keys, "h_full"]) for side in rest]
        new = [r.select(*keys, F.lit(s).alias("side"), "node_id", "pre_size", "h_full", "unique") for r, s in zip(roots, ("left", "right"), strict=True)]
        new = written(new[0].unionByName(new[1]), "treejoin-roots")
        found = new if found is None else found.unionByName(new)
        rest = [_uncovered(side, root, keys) for side, root in zip(rest, roots, strict=True)]
    if found is None:
        return left.limit(0).select(*keys, F.lit("left").alias("side"), "node_id", "pre_size", "h_full", F.lit(True).alias("unique"))
    return found


def settle(left: DataFrame, right: DataFrame, keys: list[str], same: list[str], tiers: list[list[tuple[Column, Column]]]) -> DataFrame:
    """(keys, src_id, dst_id, tier): rows of two tables that agree in the columns ``same``, each at most once.

    A tier adds conditions, as columns of either side that must be equal (null never
    is).  The strictest tier comes first; in a tier the k-th row of the left is taken with the
    k-th of the right, by node_id, and taken rows are out of later tiers.  So n and m equal rows cost n + m rows, not n * m.
    """
    sides = [left, right]
    found = None
    for n, tier in enumerate(tiers):
        numbered = []
        for k, side in enumerate(sides):
            marks = {f"_t{i}": pair[k] for i, pair in enumerate(tier)}
            known = side.withColumns(marks).where(F.expr(" AND ".join(["true", *(f"{m} IS NOT NULL" for m in marks)])))
            order = Window.partitionBy(*keys, *same, *marks).orderBy("node_id")
            numbered.append(known.select(*keys, *same, *marks, F.col("node_id").alias("src_id" if k == 0 else "dst_id"), F.row_number().over(order).alias("_k")))
        taken = numbered[0].join(large(numbered[1]), [*keys, *same, *(f"_t{i}" for i in range(len(tier))), "_k"]).select(*keys, "src_id", "dst_id", F.lit(n).alias("tier"))
        taken = written(taken, "treejoin-tier")
        found = taken if found is None else found.unionByName(taken)
        sides = [side.join(large(taken.select(*keys, F.col(c).alias("node_id"))), [*keys, "node_id"], "left_anti") for side, c in zip(sides, ("src_id", "dst_id"), strict=True)]
    return found


def expanded(roots: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id): every node of the matched equal subtrees ``roots`` (keys, src_id, dst_id, pre_size if known): equal subtrees have equal offsets."""
    if "pre_size" not in roots.columns:
        roots = roots.join(large(left.select(*keys, F.col("node_id").alias("src_id"), "pre_size")), [*keys, "src_id"])
    # In stretches, as a list of all places of a huge subtree would be one value.
    parts = roots.select(*keys, "src_id", "dst_id", "pre_size", F.explode(F.expr(f"sequence(0, pre_size - 1, {I.WIDTH})")).alias("_from"))
    steps = parts.select(*keys, "src_id", "dst_id", F.explode(F.expr(f"sequence(_from, least(_from + {I.WIDTH}, pre_size) - 1)")).alias("_k"))
    return steps.select(*keys, (F.col("src_id") + F.col("_k")).alias("src_id"), (F.col("dst_id") + F.col("_k")).alias("dst_id"))


def _with_family(nodes: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, node_id, ...) with parent_id, child_index, _parent and _grand, the types above."""
    own = nodes.select(*keys, "node_id", "parent_id", "child_index")
    inner = nodes.where("pre_size > 1")
    up = inner.select(*keys, F.col("node_id").alias("parent_id"), F.col("type").alias("_parent"), F.col("parent_id").alias("_p2"), F.col("child_index").alias("_parent_place"))
    upper = inner.select(*keys, F.col("node_id").alias("_p2"), F.col("type").alias("_grand"))
    return rows.join(large(own), [*keys, "node_id"]).join(large(up), [*keys, "parent_id"], "left").join(large(upper), [*keys, "_p2"], "left").drop("_p2")


def parent_votes(mapping: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id, votes): for each parent of mapped nodes the parent that most partners of its children have, the smallest of several."""
    up = mapping.join(large(left.select(*keys, F.col("node_id").alias("src_id"), F.col("parent_id").alias("p"))), [*keys, "src_id"]).join(large(right.select(*keys, F.col("node_id").alias("dst_id"), F.col("parent_id").alias("q"))), [*keys, "dst_id"])
    votes = up.where("p >= 0 AND q >= 0").groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys, "p").agg(F.max(F.struct("votes", -F.col("q"))).alias("_b"))
    return best.select(*keys, F.col("p").alias("src_id"), (-F.col("_b.col2")).alias("dst_id"), F.col("_b.votes").alias("votes"))


def top_down(left: DataFrame, right: DataFrame, keys: list[str], min_height: int = MIN_HEIGHT) -> DataFrame:
    """(keys, src_id, dst_id): nodes of the largest equal subtrees of both sides.

    Unique subtrees are mapped.  Of ambiguous ones those are taken first whose parent is the one that
    most mapped children of the other's parent point to, then those that agree in the types above
    and in their place, then in the types, then in document order.
    """
    found = written(equal_subtrees(left, right, keys, min_height), "treejoin-equal")
    unique = [found.where(f"unique AND side = '{s}'").select(*keys, "h_full", F.col("node_id").alias(c), "pre_size") for s, c in (("left", "src_id"), ("right", "dst_id"))]
    sure = written(unique[0].join(large(unique[1].drop("pre_size")), [*keys, "h_full"]).select(*keys, "src_id", "dst_id", "pre_size"), "treejoin-unique")
    if not found.where("NOT unique").head(1):
        return expanded(sure, left, keys)
    waiting = [_with_family(nodes, found.where(f"NOT unique AND side = '{s}'").select(*keys, "node_id", "h_full"), keys) for s, nodes in (("left", left), ("right", right))]
    votes = parent_votes(sure, left, right, keys).select(*keys, F.col("src_id").alias("parent_id"), F.col("dst_id").alias("_voted"))
    waiting = [written(waiting[0].join(large(votes), [*keys, "parent_id"], "left"), "treejoin-waiting"), written(waiting[1], "treejoin-waiting")]
    parents, grands, place = (F.col("_parent"),) * 2, (F.coalesce("_grand", F.lit("")),) * 2, (F.col("child_index"),) * 2
    voted = (F.col("_voted"), F.col("parent_id"))
    tiers = [[voted, place], [voted], [parents, grands, place], [parents, grands], [parents], []]
    settled = settle(*waiting, keys, ["h_full"], tiers).drop("tier")
    return expanded(sure.drop("pre_size").unionByName(settled), left, keys)


def common_descendants(mapping: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id, common, dice, overlap) of every two subtrees of ``left`` and ``right`` that have partners below their roots.

    ``left`` and ``right`` (keys, node_id, pre_size) are the subtrees to look at,
    and may have ``type``, which must then agree.  Two range joins meet at the mapping: the
    subtrees around a node, and those around its partner.
    """
    typed = ["type"] if "type" in left.columns and "type" in right.columns else []
    sides = []
    for side, c, own in ((left, "src_id", "x"), (right, "dst_id", "y")):
        roots = side.where("pre_size > 1").select(*keys, *typed, F.col("node_id").alias(own), F.col("pre_size").alias(f"_n{own}"), (F.col("node_id") + 1).alias("_from"), (F.col("node_id") + F.col("pre_size")).alias("_to"))
        sides.append(I.inside(mapping.select(*keys, "src_id", "dst_id"), roots, keys, c, "_from", "_to").drop("_from", "_to"))
    both = sides[0].join(large(sides[1]), [*keys, "src_id", "dst_id", *typed])
    counts = both.groupBy(*keys, "x", "y", "_nx", "_ny").agg(F.count(F.lit(1)).alias("common"))
    dice = 2.0 * F.col("common") / (F.col("_nx") + F.col("_ny") - 2)
    overlap = F.col("common") / (F.greatest("_nx", "_ny") - 1)
    return counts.select(*keys, F.col("x").alias("src_id"), F.col("y").alias("dst_id"), "common", dice.alias("dice"), overlap.alias("overlap"))


_CANDIDATE = ("dst_id", "sim", "dice", "same_place", "host_match", "labels", "key_match", "by_key")


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id): the candidate that each source node ends with, when its candidates are looked at in order.

    ``candidates`` has (keys, src_id, rank, dst_id, sim, dice, same_place, host_match,
    labels, key_match, by_key).  A candidate takes the place of the one before if, in this order:
    keys count (``by_key``) and it alone has the same key; its similarity is larger by more than
    the tolerance; within the tolerance, it alone has the same place, or its similarity is larger, or equal with a larger
    Dice coefficient, or equal in both and it alone has a matching host, or all that and more labels in common.
    "Within the tolerance" does not carry over from one candidate to the next, so this is a fold and not a maximum.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", *_CANDIDATE)))
    none = F.struct(
        F.lit(None).cast(candidates.schema["dst_id"].dataType).alias("dst_id"), F.lit(-1.0).alias("sim"), F.lit(-1.0).alias("dice"), F.lit(False).alias("same_place"),
        F.lit(True).alias("host_match"), F.lit(-1).cast("long").alias("labels"), F.lit(False).alias("key_match"),
    )

    def better(best: Column, c: Column) -> Column:
        more = (c["dice"] > best["dice"]) | (c["dice"] == best["dice"]) & (c["host_match"] & ~best["host_match"] | (c["host_match"] == best["host_match"]) & (c["labels"] > best["labels"]))
        near = c["same_place"] & ~best["same_place"] | (c["sim"] > best["sim"]) | (c["sim"] == best["sim"]) & more
        far = F.abs(c["sim"] - best["sim"]) > TOLERANCE
        return F.when(c["by_key"] & (c["key_match"] != best["key_match"]), c["key_match"]).otherwise(F.when(far, c["sim"] > best["sim"]).otherwise(near))

    def step(best: Column, c: Column) -> Column:
        new = F.struct(c["dst_id"].alias("dst_id"), c["sim"].cast("double").alias("sim"), c["dice"].cast("double").alias("dice"), c["same_place"].alias("same_place"), c["host_match"].alias("host_match"), c["labels"].cast("long").alias("labels"), c["key_match"].alias("key_match"))
        return F.when(better(best, c), new).otherwise(best)

    return candidates.groupBy(*keys, "src_id").agg(rows.alias("_c")).select(*keys, "src_id", F.aggregate("_c", none, step)["dst_id"].alias("dst_id"))


def nearest_mapped(nodes: DataFrame, mapping: DataFrame, keys: list[str], side: str = "left", points: DataFrame | None = None) -> DataFrame:
    """(keys, node_id, host, partner): the innermost mapped ancestor of each node (of ``points``, if given) and its partner; null without one."""
    own, other = ("src_id", "dst_id") if side == "left" else ("dst_id", "src_id")
    pairs = mapping.select(*keys, F.col(own).alias("host"), F.col(other).alias("partner"))
    hosts = nodes.where("pre_size > 1").select(*keys, F.col("node_id").alias("host"), "pre_size").join(large(pairs), [*keys, "host"])
    hosts = hosts.select(*keys, F.col("host").alias("_h"), (F.col("host") + F.col("pre_size")).alias("_to"))
    return I.enclosing(nodes if points is None else points, hosts, keys, "node_id", "_h", "_to").join(large(pairs), [*keys, "host"], "left").select(*keys, "node_id", "host", "partner")


def match_leaves(left: DataFrame, right: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id): free leaves of one type and label whose surroundings agree, in order of how much does.

    Keywords and leaves without a label are left out.  From the best tier down:
    parents that are partners, with both places equal, then without; a neighbour on one
    side that is mapped to the other's neighbour there; then the same nearest mapped ancestor, also where parents are free:
    with equal places of the leaf and of its parent, with equal places of the leaf, and
    at most two levels below the ancestor, or below parents with a quarter of their descendants in common.
    """
    sides = []
    for nodes, own, other, side in ((left, "src_id", "dst_id", "left"), (right, "dst_id", "src_id", "right")):
        pairs = mapping.select(*keys, F.col(own).alias("node_id"), F.col(other).alias("_partner"))
        free = nodes.join(large(pairs), [*keys, "node_id"], "left_anti")
        leaves = free.where("pre_size = 1 AND label != '' AND NOT is_keyword AND parent_id >= 0").select(*keys, "node_id", "type", "label", "depth")
        leaves = _with_family(nodes, leaves, keys)
        hosts = nearest_mapped(nodes, mapping, keys, side, leaves.select(*keys, "node_id"))
        depths = nodes.select(*keys, F.col("node_id").alias("host"), F.col("depth").alias("_host_depth"))
        leaves = leaves.join(large(hosts.where("host IS NOT NULL")), [*keys, "node_id"]).join(large(depths), [*keys, "host"])
        # The pair of a host, and of a neighbour, is named by its source node on both sides.
        name = F.col("host") if side == "left" else F.col("partner")
        mapped = pairs.withColumn("_pair", F.col("node_id") if side == "left" else F.col("_partner"))
        row = nodes.join(large(mapped), [*keys, "node_id"]).select(*keys, "parent_id", F.col("child_index").alias("_at"), "_pair")
        for step, c in ((-1, "_before"), (1, "_behind")):
            near = row.select(*keys, "parent_id", (F.col("_at") - step).alias("child_index"), F.col("_pair").alias(c))
            leaves = leaves.join(large(near), [*keys, "parent_id", "child_index"], "left")
        sides.append(leaves.withColumns({"_host": name, "_own": F.when(F.col("parent_id") == F.col("host"), name), "_near": F.when(F.col("depth") - F.col("_host_depth") <= LEAF_DEPTH, F.lit(True))}))
    # Parents with enough in common, of leaves that are still to be placed.
    tall = [nodes.join(large(leaves.select(*keys, F.col("parent_id").alias("node_id")).distinct()), [*keys, "node_id"], "left_semi").select(*keys, "node_id", "pre_size") for nodes, leaves in zip((left, right), sides, strict=True)]
    alike = common_descendants(mapping, *tall, keys).where(F.col("dice") >= LEAF_DICE).groupBy(*keys, "src_id").agg(F.max(F.struct("dice", -F.col("dst_id"))).alias("_b"))
    alike = alike.select(*keys, F.col("src_id").alias("parent_id"), (-F.col("_b.col2")).alias("_alike"))
    sides = [written(sides[0].join(large(alike), [*keys, "parent_id"], "left"), "treejoin-leaves"), written(sides[1], "treejoin-leaves")]

    def same(c: str) -> tuple[Column, Column]:
        return F.col(c), F.col(c)

    host = same("_host")
    tiers = [
        [same("_own"), same("child_index")], [same("_own")], [host, same("_before"), same("_behind")], [host, same("_before")], [host, same("_behind")],
        [host, same("_near"), same("_parent_place"), same("child_index")], [host, same("_near"), same("child_index")], [host, same("_near")], [host, (F.col("_alike"), F.col("parent_id"))],
    ]
    return settle(*sides, keys, ["type", "label"], tiers).drop("tier")


def match_containers(left: DataFrame, right: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``mapping`` with free containers that have a mapped child, each with the free one of its type that fits best.

    Innermost first: a container is decided when none inside it is open.  It is accepted with half of all
    descendants in common, or a share that falls with the logarithm of the sizes.  Of several that end with one
    candidate the first in the text is taken and the others decide again without it.  The roots belong to each other at the end.
    """
    both = []
    for nodes, own, other in ((left, "src_id", "dst_id"), (right, "dst_id", "src_id")):
        words = nodes.where("pre_size = 1 AND label != ''").select(*keys, F.col("node_id").alias("_w"), F.col("label").alias("_label"))
        both.append((nodes.where("pre_size > 1 AND parent_id >= 0"), own, words))
    rejected = mapping.limit(0).select(*keys, F.col("src_id").alias("node_id"))
    while True:
        free = [inner.join(large(mapping.select(*keys, F.col(own).alias("node_id"))), [*keys, "node_id"], "left_anti") for inner, own, _ in both]
        children = left.select(*keys, F.col("node_id").alias("src_id"), F.col("parent_id").alias("node_id")).join(large(mapping), [*keys, "src_id"]).select(*keys, "node_id").distinct()
        able = free[0].join(large(children), [*keys, "node_id"], "left_semi").join(large(rejected), [*keys, "node_id"], "left_anti")
        cols = [*keys, "node_id", "pre_size", "type"]
        found = written(common_descendants(mapping, able.select(*cols), free[1].select(*cols), keys), "treejoin-containers")
        if not found.head(1):
            break
        open_ones = found.select(*keys, F.col("src_id").alias("node_id")).distinct().join(large(left.select(*keys, "node_id", "pre_size")), [*keys, "node_id"])
        ranges = open_ones.select(*keys, F.col("node_id").alias("_h"), (F.col("node_id") + 1).alias("_from"), (F.col("node_id") + F.col("pre_size")).alias("_to"))
        outer = I.inside(open_ones.select(*keys, "node_id"), ranges, keys, "node_id", "_from", "_to").select(*keys, F.col("_h").alias("src_id")).distinct()
        now = found.join(large(outer), [*keys, "src_id"], "left_anti")
        chosen = written(best_candidates(_features(now, left, right, mapping, keys, both[0][2]), keys).join(large(found), [*keys, "src_id", "dst_id"]), "treejoin-chosen")
        sizes = chosen.join(large(left.select(*keys, F.col("node_id").alias("src_id"), F.col("pre_size").alias("_n"))), [*keys, "src_id"]).join(large(right.select(*keys, F.col("node_id").alias("dst_id"), F.col("pre_size").alias("_m"))), [*keys, "dst_id"])
        good = (F.col("dice") >= MIN_DICE) | (F.col("overlap") >= 1 / (1 + F.log(F.col("_n") + F.col("_m") - 2)))
        judged = sizes.select(*keys, "src_id", "dst_id", good.alias("_good"))
        first = judged.where("_good").groupBy(*keys, "dst_id").agg(F.min("src_id").alias("src_id"))
        mapping = written(mapping.unionByName(first.select(*mapping.columns)), "treejoin-mapping")
        rejected = written(rejected.unionByName(judged.where("NOT _good").select(*keys, F.col("src_id").alias("node_id"))), "treejoin-rejected")
    roots = left.where("parent_id < 0").select(*keys, F.col("node_id").alias("src_id")).join(large(right.where("parent_id < 0").select(*keys, F.col("node_id").alias("dst_id"))), keys)
    for c in ("src_id", "dst_id"):
        roots = roots.join(large(mapping.select(*keys, c)), [*keys, c], "left_anti")
    return mapping.unionByName(roots.select(*mapping.columns))


def _features(found: DataFrame, left: DataFrame, right: DataFrame, mapping: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """Candidates (src_id, dst_id, dice, overlap) with all that :func:`best_candidates` looks at; they are met from partners of the first descendants upwards."""
    pairs = found.select(*keys, "src_id", "dst_id").distinct()
    place = [side.select(*keys, F.col("node_id").alias(own), F.col("child_index").alias(f"_place_{own}"), F.col("pre_size").alias(f"_size_{own}")) for side, own in ((left, "src_id"), (right, "dst_id"))]
    out = found.join(large(place[0]), [*keys, "src_id"]).join(large(place[1]), [*keys, "dst_id"])
    for nodes, own, side in ((left, "src_id", "left"), (right, "dst_id", "right")):
        hosts = nearest_mapped(nodes, mapping, keys, side, pairs.select(*keys, F.col(own).alias("node_id")).distinct())
        name = F.col("host") if side == "left" else F.col("partner")
        out = out.join(large(hosts.select(*keys, F.col("node_id").alias(own), name.alias(f"_host_{own}"))), [*keys, own], "left")
    # Labels below the candidate that are among those below the source.
    own = I.inside(words, out.select(*keys, "src_id", (F.col("src_id") + F.col("_size_src_id")).alias("_to")).distinct(), keys, "_w", "src_id", "_to").select(*keys, "src_id", "_label").distinct()
    there = right.where("label != ''").select(*keys, F.col("node_id").alias("_w"), F.col("label").alias("_label"))
    there = I.inside(there, out.select(*keys, "dst_id", (F.col("dst_id") + F.col("_size_dst_id")).alias("_to")).distinct(), keys, "_w", "dst_id", "_to").groupBy(*keys, "dst_id", "_label").agg(F.count(F.lit(1)).alias("_n"))
    labels = pairs.join(large(own), [*keys, "src_id"]).join(large(there), [*keys, "dst_id", "_label"]).groupBy(*keys, "src_id", "dst_id").agg(F.sum("_n").alias("labels"))
    # Where a candidate is first met: the first descendant with a partner below it.
    inner = I.inside(mapping, out.select(*keys, F.col("src_id").alias("_x"), (F.col("src_id") + 1).alias("_from"), (F.col("src_id") + F.col("_size_src_id")).alias("_to")).distinct(), keys, "src_id", "_from", "_to")
    inner = inner.select(*keys, F.col("_x").alias("x"), F.col("src_id").alias("_d"), F.col("dst_id").alias("_e"))
    met = out.select(*keys, F.col("src_id").alias("x"), "dst_id", (F.col("dst_id") + F.col("_size_dst_id")).alias("_to")).join(large(inner), [*keys, "x"]).where("_e > dst_id AND _e < _to")
    met = met.groupBy(*keys, F.col("x").alias("src_id"), "dst_id").agg(F.min("_d").alias("_first"))
    out = out.join(large(labels), [*keys, "src_id", "dst_id"], "left").join(large(met), [*keys, "src_id", "dst_id"])
    return out.select(
        *keys, "src_id", F.struct("_first", -F.col("dst_id")).alias("rank"), "dst_id", F.col("overlap").alias("sim"), "dice", (F.col("_place_src_id") == F.col("_place_dst_id")).alias("same_place"),
        F.col("_host_src_id").eqNullSafe(F.col("_host_dst_id")).alias("host_match"), F.coalesce("labels", F.lit(0)).alias("labels"), F.lit(False).alias("key_match"), F.lit(False).alias("by_key"),
    )


def match_tables(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_id, dst_id): equal subtrees, containers from within, leaves that share an ancestor, parents of most partners, in this order.

    Without what needs one pair at a time (recovery below a matched pair, contests): for pairs beyond one task.
    """
    mapping = written(top_down(left, right, keys), "treejoin-mapping")
    mapping = written(match_containers(left, right, mapping, keys), "treejoin-mapping")
    mapping = written(mapping.unionByName(match_leaves(left, right, mapping, keys).select(*mapping.columns)), "treejoin-mapping")
    votes = parent_votes(mapping, left, right, keys)
    for nodes, own in ((left, "src_id"), (right, "dst_id")):
        votes = votes.join(large(mapping.select(*keys, own)), [*keys, own], "left_anti").join(large(nodes.select(*keys, F.col("node_id").alias(own), F.col("type").alias(f"_{own}"))), [*keys, own])
    votes = votes.where("_src_id = _dst_id").groupBy(*keys, "dst_id").agg(F.max_by("src_id", F.struct("votes", -F.col("src_id"))).alias("src_id"))
    return mapping.unionByName(votes.select(*mapping.columns))
