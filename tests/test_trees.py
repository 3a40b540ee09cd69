import json

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import editscript as E
from palimpsest.operators.treematch import edit_distance, match
from palimpsest.sources.trees import UNORDERED, Tree, parse_html, parse_json

values = st.recursive(
    st.none() | st.booleans() | st.integers(-3, 3) | st.text("abé\"\\", max_size=3),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.sampled_from("abcd"), v, max_size=4),
    max_leaves=25,
)
words = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "one", "two é", "<br>", '<a href="x" id=y>', "</a>", "<!-- c -->", "<script>a<b</script>"])
pages = st.lists(words, max_size=25).map(" ".join)


def nested(t: Tree, i: int = 0):
    return t.kind[i], t.label[i], tuple(nested(t, c) for c in t.children[i])


def unordered(node):
    kind, label, below = node
    below = tuple(map(unordered, below))
    return kind, label, tuple(sorted(below)) if kind in UNORDERED else below


def holds(a: Tree, b: Tree):
    m = match(a, b)
    linked = [(x, int(y)) for x, y in enumerate(m.to) if y >= 0]
    assert all(m.back[y] == x and a.kind[x] == b.kind[y] for x, y in linked)
    actions = E.script(m)
    assert [unordered(n) for n in E.apply(a, b, actions)] == [unordered(nested(b))]
    if nested(a) == nested(b):
        assert not actions
    return m, actions


@settings(max_examples=150, deadline=None)
@given(values, values)
def test_json_script_makes_the_destination(x, y):
    holds(parse_json(json.dumps(x)), parse_json(json.dumps(y)))


@settings(max_examples=150, deadline=None)
@given(pages, pages)
def test_html_script_makes_the_destination(x, y):
    holds(parse_html(x), parse_html(y))


@settings(max_examples=60, deadline=None)
@given(values)
def test_json_offsets(value):
    text = json.dumps(value, ensure_ascii=False)
    t, raw = parse_json(text), text.encode()
    assert t.errors == 0
    for i in range(len(t)):
        if t.label[i]:
            assert raw[t.start[i] : t.end[i]].decode() == t.label[i]
        assert t.size[i] == 1 + sum(t.size[c] for c in t.children[i])
        assert all(t.start[i] <= t.start[c] and t.end[c] <= t.end[i] for c in t.children[i])


def test_html_nodes():
    t = parse_html('<!DOCTYPE html><p class="a">é<b>x</b><p>y<br><script>var t="</p>";</script>')
    assert [(k, v) for k, v in zip(t.kind, t.label, strict=True)] == [
        ("document", ""), ("doctype", "DOCTYPE html"), ("element", "p"), ("attributes", ""), ("attribute", ""), ("name", "class"), ("value", '"a"'),
        ("text", "é"), ("element", "b"), ("text", "x"), ("element", "p"), ("text", "y"), ("element", "br"), ("element", "script"), ("raw_text", 'var t="</p>";'),
    ]
    assert t.errors == 0 and t.start[8] == t.start[7] + 2
    assert parse_html("<div><b>x</div>").errors == 1 and parse_html("x</i>").errors == 1


def test_errors_are_counted():
    assert parse_json('{"a": 1').errors == 1 and parse_json("]").errors == 1 and parse_json("{}").errors == 0
    assert len(parse_json("")) == 1 and len(parse_html("")) == 1


def test_edit_distance():
    one, two = parse_json("[1, [2, 3], 4]"), parse_json("[1, [2, 5], 4, 6]")
    assert edit_distance(one, two)[0] == 2.0 and edit_distance(one, one)[0] == 0.0


def test_actions_of_small_edits():
    def kinds(x, y):
        m = match(parse_html(x), parse_html(y))
        return [(a.action, a.subtree) for a in E.collapse(m, E.script(m))]

    assert kinds("<p>a</p>", "<p>a</p><ul><li>x</ul>") == [("insert", True)]
    assert kinds("<p>a</p><ul><li>x</ul>", "<p>a</p>") == [("delete", True)]
    assert kinds("<p>a</p>", "<p>b</p>") == [("update", False)]
    assert kinds("<p>a a</p><p>b b</p><p>c c</p>", "<p>c c</p><p>a a</p><p>b b</p>") == [("move", True)]


def test_queries(spark):
    rows = [(1, 2, "<p>a</p><p>b</p>", "<p>b</p><p>a</p><i>z</i>"), (3, 4, None, None), (5, 6, "", "<b>x</b>")]
    pairs = spark.createDataFrame(rows, "a long, b long, src string, dst string")
    actions = E.tree_actions(pairs, "html")
    got = {(r.a, r.action): r.n for r in E.action_summary(actions).collect()}
    assert got == {(1, "move"): 1, (1, "insert"): 1, (5, "insert"): 1}
    assert E.tree_mappings(pairs, "html").where("a = 3").count() == 1
    assert E.tree_actions(pairs.limit(0), "html").count() == 0
