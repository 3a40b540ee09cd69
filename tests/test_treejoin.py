"""Matching by joins against loops over small trees."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import treejoin as J

SCHEMA = "a long, node_id int, parent_id int, child_index int, depth int, height int, pre_size int, type string, label string, h_full long, is_keyword boolean"


class Tree:
    """From nested (type, label, children)."""

    def __init__(self, nested):
        self.kind, self.label, self.parent, self.place, self.depth, self.size, self.height, self.full = ([] for _ in range(8))

        def walk(node, parent, place, depth):
            i = len(self.kind)
            for column, v in ((self.kind, node[0]), (self.label, node[1]), (self.parent, parent), (self.place, place), (self.depth, depth), (self.size, 1), (self.height, 1), (self.full, 0)):
                column.append(v)
            hashes = []
            for k, c in enumerate(node[2]):
                j = walk(c, i, k, depth + 1)
                self.size[i] += self.size[j]
                self.height[i] = max(self.height[i], self.height[j] + 1)
                hashes.append(self.full[j])
            self.full[i] = hash((node[0], node[1], tuple(hashes))) >> 1
            return i

        walk(nested, -1, -1, 0)

    def rows(self, key):
        return [(key, i, self.parent[i], self.place[i], self.depth[i], self.height[i], self.size[i], self.kind[i], self.label[i], self.full[i], self.kind[i] == "kw") for i in range(len(self.kind))]


def leaf(kind, label):
    return (kind, label, ())


def grow(draw, depth):
    if depth == 0 or draw.random() < 0.25:
        return leaf("leaf", draw.choice("abc"))
    return (draw.choice("pq"), "", tuple(grow(draw, depth - 1) for _ in range(draw.randint(1, 3))))


def changed(draw, node):
    kind, label, below = node
    if not below:
        return leaf(kind, draw.choice("abcx")) if draw.random() < 0.15 else node
    below = [changed(draw, c) for c in below]
    if draw.random() < 0.2:
        draw.shuffle(below)
    if draw.random() < 0.15:
        below.append(grow(draw, 2))
    return (kind, label, tuple(below))


def tables(spark, pairs):
    return [spark.createDataFrame([r for k, p in enumerate(pairs) for r in p[side].rows(k)], SCHEMA) for side in range(2)]


def by_height(a, b, min_height=2):
    """Walk from the tallest nodes down; a node below a settled one is out."""
    out = ([False] * len(a.kind), [False] * len(b.kind))
    found = set()
    for height in range(max(*a.height, *b.height), min_height - 1, -1):
        groups = defaultdict(lambda: ([], []))
        for side, t in enumerate((a, b)):
            for i in range(len(t.kind)):
                if t.height[i] == height and not out[side][i]:
                    groups[t.full[i]][side].append(i)
        for xs, ys in groups.values():
            if xs and ys:
                for side, t, rows in ((0, a, xs), (1, b, ys)):
                    for i in rows:
                        found.add(("left" if side == 0 else "right", i, len(xs) == len(ys) == 1))
                        out[side][i : i + t.size[i]] = [True] * t.size[i]
    return found


def test_equal_subtrees(spark):
    draw = random.Random(7)
    pairs = []
    for _ in range(25):
        one = grow(draw, 5)
        pairs.append((Tree(one), Tree(changed(draw, one))))
    left, right = tables(spark, pairs)
    got = defaultdict(set)
    for r in J.equal_subtrees(left, right, ["a"]).collect():
        got[r.a].add((r.side, r.node_id, r.unique))
    assert all(got[k] == by_height(*p) for k, p in enumerate(pairs)) and any(len(g) > 6 for g in got.values())

    mapping = defaultdict(list)
    for r in J.top_down(left, right, ["a"]).collect():
        mapping[r.a].append((r.src_id, r.dst_id))
    for k, (a, b) in enumerate(pairs):
        xs, ys = zip(*mapping[k], strict=True) if mapping[k] else ((), ())
        assert len(set(xs)) == len(xs) and len(set(ys)) == len(ys)
        assert all((a.kind[x], a.label[x]) == (b.kind[y], b.label[y]) for x, y in mapping[k])
        roots = by_height(a, b)
        sure = {h: i for s, i, u in roots if u and s == "right" for h in [b.full[i]]}
        assert {(i, sure[a.full[i]]) for s, i, u in roots if u and s == "left"} <= set(mapping[k])
        # Of an ambiguous hash as many are mapped as the smaller side has.
        for h in {a.full[i] for s, i, u in roots if not u and s == "left"}:
            n = [sum(not u and s == side and t.full[i] == h for s, i, u in roots) for side, t in (("left", a), ("right", b))]
            assert sum((i, y) in set(mapping[k]) for s, i, u in roots if not u and s == "left" and a.full[i] == h for y in ys) == min(n)


def test_hidden_copies(spark):
    """A subtree that the other side has only inside a taller match is settled when that match is gone."""
    inner = ("p", "", (leaf("leaf", "a"), leaf("leaf", "b")))
    outer = ("q", "", (inner, leaf("leaf", "c")))
    pairs = [(Tree(("r", "", (outer, inner))), Tree(("r", "", (leaf("leaf", "z"), outer)))), (Tree(("r", "", (inner, inner, inner))), Tree(("r", "", (inner, leaf("leaf", "q"), inner)))), (Tree(outer), Tree(outer)), (Tree(leaf("leaf", "a")), Tree(inner))]
    left, right = tables(spark, pairs)
    got = defaultdict(set)
    for r in J.equal_subtrees(left, right, ["a"]).collect():
        got[r.a].add((r.side, r.node_id, r.unique))
    assert [got[k] for k in range(4)] == [by_height(*p) for p in pairs]
    found = {(r.a, r.src_id, r.dst_id) for r in J.top_down(left, right, ["a"]).collect()}
    assert (0, 1, 2) in found and not any(k == 0 and x >= 6 for k, x, _ in found)
    assert {(x, y) for k, x, y in found if k == 1} == {(1, 1), (2, 2), (3, 3), (7, 5), (8, 6), (9, 7)}  # first and third, by place
    assert J.top_down(left.limit(0), right, ["a"]).collect() == []


def test_common_descendants(spark):
    draw = random.Random(9)
    pairs = [(Tree(grow(draw, 4)), Tree(grow(draw, 4))) for _ in range(6)]
    left, right = tables(spark, pairs)
    mapping, wanted = [], {}
    for k, (a, b) in enumerate(pairs):
        own = list(zip(draw.sample(range(len(a.kind)), m := min(len(a.kind), len(b.kind)) * 2 // 3), draw.sample(range(len(b.kind)), m), strict=True))
        mapping += [(k, x, y) for x, y in own]
        for x in range(len(a.kind)):
            for y in range(len(b.kind)):
                n = sum(x < u < x + a.size[x] and y < v < y + b.size[y] for u, v in own)
                if n and a.kind[x] == b.kind[y]:
                    wanted[k, x, y] = (n, 2 * n / (a.size[x] + b.size[y] - 2), n / (max(a.size[x], b.size[y]) - 1))
    table = spark.createDataFrame(mapping, "a long, src_id int, dst_id int")
    got = {(r.a, r.src_id, r.dst_id): (r.common, r.dice, r.overlap) for r in J.common_descendants(table, left, right, ["a"]).collect()}
    assert got.keys() == wanted.keys() and all(got[k][0] == wanted[k][0] and math.isclose(got[k][1], wanted[k][1]) and math.isclose(got[k][2], wanted[k][2]) for k in got)
    hosts = {(r.a, r.node_id): (r.host, r.partner) for r in J.nearest_mapped(left, table, ["a"]).collect()}
    for k, (a, _) in enumerate(pairs):
        own = {x: y for kk, x, y in mapping if kk == k}
        for i in range(len(a.kind)):
            p = a.parent[i]
            while p >= 0 and p not in own:
                p = a.parent[p]
            assert hosts[k, i] == ((p, own[p]) if p >= 0 else (None, None))


def test_best_candidates(spark):
    """The fold against a loop; some orders end elsewhere than any maximum would."""
    draw = random.Random(11)
    rows = [(k, 0, r, 100 + r, draw.choice([0.5, 0.52, 0.54, 0.56, 0.58, 0.7]), draw.choice([0.3, 0.4]), draw.random() < 0.3, draw.random() < 0.5, draw.randrange(3), draw.random() < 0.4, k % 3 == 0) for k in range(200) for r in range(draw.randint(1, 6))]
    wanted, drift = {}, 0
    for k in range(200):
        best = (None, -1.0, -1.0, False, True, -1, False)
        own = [r for r in rows if r[0] == k]
        for _, _, _, y, sim, dice, place, host, labels, key, by_key in own:
            if by_key and key != best[6]:
                take = key
            elif abs(sim - best[1]) > 0.05:
                take = sim > best[1]
            elif place and not best[3]:
                take = True
            elif sim != best[1]:
                take = sim > best[1]
            elif dice != best[2]:
                take = dice > best[2]
            elif host != best[4]:
                take = host
            else:
                take = labels > best[5]
            if take:
                best = (y, sim, dice, place, host, labels, key)
        wanted[k] = best[0]
        drift += best[1] < max(r[4] for r in own) - 0.05
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "a long, src_id int, rank int, dst_id int, sim double, dice double, same_place boolean, host_match boolean, labels int, key_match boolean, by_key boolean")
    assert {r.a: r.dst_id for r in J.best_candidates(table, ["a"]).collect()} == wanted and drift


def test_leaves_under_free_parents(spark):
    """Leaves whose parent is a new wrapper go to their partner if a mapped ancestor is shared, and not elsewhere."""
    word, other = leaf("leaf", "one"), leaf("leaf", "two")
    a = Tree(("r", "", (("p", "", (word, other)), ("q", "", (word,)), ("kw", "if", ()))))
    b = Tree(("r", "", (("p", "", (("w", "", (word,)), other)), ("q", "", (("w", "", (("w", "", (word,)),)),)), ("kw", "if", ()))))
    left, right = tables(spark, [(a, b)])
    mapping = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 4, 5)], "a long, src_id int, dst_id int")
    got = {(r.src_id, r.dst_id) for r in J.match_leaves(left, right, mapping, ["a"]).collect()}
    assert got == {(2, 3), (3, 4)}  # three levels below q is too far; keywords are not leaves of this step


@pytest.mark.parametrize("n", [1, 40])
def test_many_equal_leaves(spark, n):
    """Equal leaves cost their number and not its square, and keep their order."""
    a, b = Tree(("r", "", tuple(leaf("leaf", "x") for _ in range(n)))), Tree(("r", "", (leaf("leaf", "y"), *(leaf("leaf", "x") for _ in range(n - 1)))))
    left, right = tables(spark, [(a, b)])
    got = sorted((r.src_id, r.dst_id) for r in J.match_leaves(left, right, spark.createDataFrame([(0, 0, 0)], "a long, src_id int, dst_id int"), ["a"]).collect())
    assert got == [(k, k) for k in range(2, n + 1)]


def test_settle_never_takes_null(spark):
    rows = spark.createDataFrame([(0, 1, None), (0, 2, "t")], "a long, node_id int, t string")
    got = J.settle(rows, rows, ["a"], [], [[(F.col("t"), F.col("t"))]]).collect()
    assert [(r.src_id, r.dst_id) for r in got] == [(2, 2)]


def by_rounds(a, b, mapping):
    """Containers from within, with loops."""
    to, back = dict(mapping), {y: x for x, y in mapping}

    def up(t, i):
        while t.parent[i] >= 0:
            i = t.parent[i]
            yield i

    def common(x, y):
        return sum(x < u < x + a.size[x] and y < v < y + b.size[y] for u, v in to.items())

    rejected = set()
    while True:
        found = {}
        for x in range(1, len(a.kind)):
            if a.size[x] > 1 and x not in to and x not in rejected and any(a.parent[c] == x and c in to for c in range(x + 1, x + a.size[x])):
                able = []
                for d in range(x + 1, x + a.size[x]):
                    able += [y for y in up(b, to[d]) if y > 0 and y not in back and b.kind[y] == a.kind[x] and y not in able] if d in to else []
                if able:
                    found[x] = able
        if not found:
            break
        chosen = {}
        for x in [x for x in found if not any(x < u < x + a.size[x] for u in found)]:
            best = (None, -1.0, -1.0, False, True, -1)
            words = {a.label[k] for k in range(x, x + a.size[x]) if a.size[k] == 1 and a.label[k]}
            host = next((p for p in up(a, x) if p in to), None)
            for y in found[x]:
                n = common(x, y)
                sim, dice, place = n / (max(a.size[x], b.size[y]) - 1), 2 * n / (a.size[x] + b.size[y] - 2), a.place[x] == b.place[y]
                there = next((q for q in up(b, y) if q in back), None)
                agree = (None if host is None else to[host]) == there
                labels = sum(b.label[k] in words for k in range(y, y + b.size[y]) if b.label[k])
                if abs(sim - best[1]) > 0.05:
                    take = sim > best[1]
                elif place and not best[3]:
                    take = True
                else:
                    take = (sim, dice, agree, labels) > (best[1], best[2], best[4], best[5])
                if take:
                    best = (y, sim, dice, place, agree, labels)
            if best[2] >= 0.5 or best[1] >= 1 / (1 + math.log(a.size[x] + b.size[best[0]] - 2)):
                chosen.setdefault(best[0], x)
            else:
                rejected.add(x)
        for y, x in chosen.items():
            to[x], back[y] = y, x
    if 0 not in to and 0 not in back:
        to[0] = 0
    return set(to.items())


def test_containers(spark):
    draw = random.Random(21)
    pairs = []
    for _ in range(12):
        one = ("r", "", tuple(grow(draw, 4) for _ in range(3)))
        pairs.append((Tree(one), Tree(changed(draw, changed(draw, one)))))
    left, right = tables(spark, pairs)
    first = J.top_down(left, right, ["a"]).cache()
    start = defaultdict(list)
    for r in first.collect():
        start[r.a].append((r.src_id, r.dst_id))
    got = defaultdict(set)
    for r in J.match_containers(left, right, first, ["a"]).collect():
        got[r.a].add((r.src_id, r.dst_id))
    assert all(got[k] == by_rounds(*p, start[k]) for k, p in enumerate(pairs)) and sum(len(got[k]) - len(start[k]) for k in got) > 15
    whole = defaultdict(list)
    for r in J.match_tables(left, right, ["a"]).collect():
        whole[r.a].append((r.src_id, r.dst_id))
    for k, (a, b) in enumerate(pairs):
        xs, ys = zip(*whole[k], strict=True)
        assert got[k] <= set(whole[k]) and len(set(xs)) == len(xs) and len(set(ys)) == len(ys) and all(a.kind[x] == b.kind[y] for x, y in whole[k])
