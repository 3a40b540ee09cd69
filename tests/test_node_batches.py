"""Node tables: many texts a batch, chosen columns, repeated texts; orders and subsequences of trees."""

from palimpsest.operators.treematch import _longest_common
from palimpsest.sources import parsing as T


def test_nodes_of_many_texts(spark):
    texts = ['{"k": 1}', None, '{"k": [1, "é"]}', '{"k": 1}', "[" + ",".join("1" * 300) + "]"]
    table = spark.createDataFrame(list(enumerate(texts * 50)), "key long, text string").coalesce(1)
    rows = T.nodes(table, "json").collect()
    alone = {t: T.parse(t or "", "json") for t in texts}
    assert len(rows) == 50 * sum(len(alone[t]) for t in texts)
    for r in rows:
        t = alone[texts[r.key % len(texts)]]
        assert (r.type, r.label, r.pre_size, r.post_start, r.h_full % (1 << 64)) == (t.kind[r.node_id], t.label[r.node_id], t.size[r.node_id], t.post_start[r.node_id], t.full[r.node_id])
    few = T.nodes(table, "json", ("key", "h_full", "label"))
    assert few.columns == ["key", "label", "h_full"]
    assert sorted(map(tuple, few.collect())) == sorted((r.key, r.label, r.h_full) for r in rows)


def test_post_order_by_place():
    t = T.parse('{"a": [1, {"b": 2}], "c": "x"}', "json")
    walked = []

    def walk(i):
        for c in t.children[i]:
            walk(c)
        walked.append(i)

    walk(0)
    assert t.post_order() == walked
    assert t.post_start == [walked.index(i) + 1 - t.size[i] for i in range(len(t))]


def test_longest_common_ends():
    import random

    def plain(left, right):
        n, m = len(left), len(right)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                table[i + 1][j + 1] = table[i][j] + 1 if left[i] == right[j] else max(table[i][j + 1], table[i + 1][j])
        out, i, j = [], n, m
        while i and j:
            if left[i - 1] == right[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    draw = random.Random(4)
    for k in range(400):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(9))] if k % 2 else draw.sample(range(12), draw.randrange(9)) for _ in "ab")
        assert _longest_common(list(range(len(a))), list(range(len(b))), a.__getitem__, b.__getitem__) == plain(a, b)
