"""Git as a source, the viewer's tables against plain loops, streams of revisions."""

import random
import subprocess

import pytest

from palimpsest.operators import nodes as N
from palimpsest.operators import viewer as V
from palimpsest.sources import git as G
from palimpsest.sources.revisions import ranges, register
from palimpsest.sources import parsing as T


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("work")

    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], cwd=path, check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (path / "a.py").write_text("x = 1\n")
    (path / "old name.py").write_text("".join(f"line {k}\n" for k in range(20)))
    git("add", ".")
    git("commit", "-qm", "one")
    (path / "a.py").write_text("x = 2\n")
    git("add", "a.py")
    (path / "a.py").write_text("x = 3\n")
    git("mv", "old name.py", "new name.py")
    (path / "extra.txt").write_text("?")
    return str(path)


def test_calls_of_git(spark, folder, tmp_path):
    assert G.is_repository(folder) and not G.is_repository(str(tmp_path)) and G.is_revision(folder, "main") and not G.is_revision(folder, "nothing")
    files = {r.path: r for r in G.status(spark, folder).collect()}
    assert files["a.py"].status == "MM" and files["new name.py"].old_path == "old name.py" and files["extra.txt"].unstaged
    assert G.content(folder, "a.py", "HEAD") == b"x = 1\n" and G.content(folder, "a.py", G.INDEX) == b"x = 2\n" and G.content(folder, "a.py", G.DISK) == b"x = 3\n"
    assert G.content(folder, "missing", "HEAD") is None and G.content(folder, "missing", G.DISK) is None
    rows = G.contents_to_compare(G.sections(G.status(spark, folder)))
    pairs = {r.pair_id: (r.src.decode(), r.dst.decode()) for r in G.pairs(folder, rows).collect()}
    assert pairs["staged:a.py"] == ("x = 1\n", "x = 2\n") and pairs["unstaged:a.py"] == ("x = 2\n", "x = 3\n") and pairs["unstaged:extra.txt"] == ("", "?")
    assert {r.path for r in G.changed_files(spark, folder, "HEAD").collect()} == {"a.py", "new name.py"}
    assert G.committable(rows).first().committable and not G.committable(rows.limit(0)).first().committable
    both = G.contents_to_compare(G.between_revisions(G.changed_files(spark, folder, "HEAD"), "HEAD"), "HEAD")
    assert {(r.left_revision, r.right_revision) for r in both.collect()} == {("HEAD", "")}


def test_revisions_as_a_data_source(spark, folder):
    """Every file of a revision, of the index and on disk; a file a partition, and bytes of any kind."""
    register(spark)

    def read(**options):
        reader = spark.read.format("git_revision").option("folder", folder)
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load()

    head = read(files=1)
    assert {r.path: bytes(r.content) for r in head.collect()} == {"a.py": b"x = 1\n", "old name.py": G.content(folder, "old name.py", "HEAD")}
    assert head.rdd.getNumPartitions() == 2 and all(r.size == len(r.content) and len(r.blob) == 40 for r in head.collect())
    assert {r.path: bytes(r.content) for r in read(revision=":").collect()}["a.py"] == b"x = 2\n"
    disk = {r.path: bytes(r.content) for r in read(revision="").collect()}
    assert disk["a.py"] == b"x = 3\n" and disk["extra.txt"] == b"?" and "new name.py" in disk
    assert read(path="nothing").collect() == [] and [r.path for r in read(path="a.py").collect()] == ["a.py"]
    assert [len(p) for p in ranges([("a", "", 5), ("b", "", 5), ("c", "", -1), ("d", "", 90), ("e", "", 1)], 3, 50)] == [3, 1, 1]


def test_layers_and_tints_against_loops(spark):
    pick = random.Random(6)
    spans = []
    for seq in range(60):
        a, n = pick.randrange(0, 20), pick.randrange(1, 12)
        spans.append((seq % 3, "left", pick.randrange(2), a, a + n, pick.choice(list(V.PRIORITY)), seq, pick.randrange(1, 6)))
    df = spark.createDataFrame(spans, "k long, side string, line int, start_col int, end_col int, action string, seq int, size int")
    cells = {}
    for k, _, line, a, b, action, _, size in spans:
        for col in range(a, b):
            key = (size, b - a, -V.PRIORITY[action])
            best, moved = cells.get((k, line, col), (((9, 99, 9), ""), False))
            cells[k, line, col] = (min(best, (key, action)), moved or action == "move")
    expected = {at: "move_update" if a == "update" and moved else a for at, ((_, a), moved) in cells.items()}
    got = {}
    for r in V.column_layers(df, ["k"]).collect():
        for col in range(r.start_col, r.end_col):
            assert (r.k, r.line, col) not in got
            got[r.k, r.line, col] = r.action
    assert got == expected
    at = spark.createDataFrame([(0, "left", 0, 7), (1, "left", 1, 0), (2, "left", 1, 99)], "k long, side string, line int, col int")
    hits = {(r.k, r.seq) for r in V.actions_at(df, at, ["k"]).collect()}
    assert hits == {(s[0], s[6]) for s in spans for k, _, line, col in ((0, "left", 0, 7), (1, "left", 1, 0), (2, "left", 1, 99)) if s[0] == k and s[2] == line and s[3] <= col < s[4]}
    steps = {r.k: ((r.next_line, r.next_col), (r.previous_line, r.previous_col)) for r in V.next_span(df, at, ["k"]).collect()}
    for k, _, line, col in at.collect():
        starts = sorted({(s[2], s[3]) for s in spans if s[0] == k})
        after, before = [s for s in starts if s > (line, col)], [s for s in starts if s < (line, col)]
        assert steps[k] == ((after or starts)[0], (before or starts)[-1])


def test_virtual_rows_and_search_in_both_panes(spark):
    grid = spark.createDataFrame([(1, k, k, k) for k in range(10)], "k long, grid_row int, left_line int, right_line int")
    folds = spark.createDataFrame([(1, 2, 5, False), (1, 7, 8, True)], "k long, start_row int, end_row int, open boolean")
    shown = V.virtual_lines(grid, folds, ["k"])
    assert [(r.virtual_row, r.row) for r in shown.orderBy("virtual_row").collect()] == [(0, 0), (1, 1), (2, None), (3, 6), (4, 7), (5, 8), (6, 9)]
    where = {r.grid_row: r.virtual_row for r in V.virtual_row_of(shown, grid, ["k"]).collect()}
    assert where[3] == 2 and where[6] == 3 and len(where) == 10
    lines = spark.createDataFrame([(1, s, k, f"{s}\tAb{'ab' * k}") for s in ("left", "right") for k in range(3)], "k long, side string, line_no int, line string")
    pane = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, -1)], "k long, virtual_row int, left_line int, right_line int")
    hits = sorted((r.virtual_row, r.pane, r.start_col) for r in V.search_pair(lines, pane, "AB", ["k"]).collect())
    assert hits == [(0, "left", 8), (0, "right", 9), (1, "left", 8), (1, "left", 10)]
    assert V.search(lines, "", ["k"], "line").count() == 0


def test_visual_columns(spark):
    df = spark.createDataFrame([("\ta\té", k) for k in range(6)], "line string, k int")
    assert [int(r[0]) for r in df.select(V.visual_column(df.line, df.k)).collect()] == [0, 4, 5, 9, 10, 11]


def test_comment_tables(spark):
    df = spark.createDataFrame([(1, "# a\ndef f():\n    # b é\n    pass\n"), (2, None)], "key long, text string")
    rows = T.comment_blocks(df, "python").collect()
    assert [(r.key, r.idx, r.text, r.start_row, r.scope_key) for r in rows] == [(1, 0, "# a", 0, "root"), (1, 1, "# b é", 2, "function_declaration:f/block")]
    nodes = T.nodes(df, "python")
    assert nodes.where("key = 2").count() == 1
    roots = nodes.where("type = 'function_declaration'")
    assert {r.label for r in N.label_frequency(nodes, roots).collect()} >= {"def", "f", "pass"}
    assert N.keyword_trees(nodes).count() == 2  # the statement of one keyword and its block


def test_relational_matching(spark):
    keys = ["k"]
    kind = "k long, node_id int, type string, name string, receiver string, pre_size int"
    left = spark.createDataFrame([(1, 1, "f", "a", "", 5), (1, 9, "f", "a", "", 9), (1, 20, "f", "b", "", 3)], kind)
    right = spark.createDataFrame([(1, 2, "f", "a", "", 8), (1, 30, "f", "b", "", 3), (1, 40, "f", "b", "", 3)], kind)
    assert [tuple(r) for r in N.declaration_partners(left, right, keys).collect()] == [(1, 9, 2)]
    spans = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 5, 5)], "k long, node_id int, start_row int, end_row int")
    matches = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (1, 2, 9)], "k long, row int, other int")
    assert [r.other_row for r in N.untouched(spans, matches, keys).orderBy("node_id").collect()] == [3, None, None]
    there = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 8, None)], "k long, node_id int, start_row int, other_row int")
    pairs = spark.createDataFrame([(1, s, d) for s in range(3) for d in range(2)], "k long, src_id int, dst_id int")
    found = N.may_match(N.untouched(spans, matches, keys), there, pairs, keys).collect()
    assert sorted((r.src_id, r.dst_id) for r in found) == [(0, 0), (1, 1), (2, 1)]


def test_stream_of_revisions(spark, tmp_path):
    from palimpsest.streaming.revisions import diff_stream, read_latest

    kind = "pair_id string, src_name string, dst_name string, src string, dst string, is_conflict boolean, revision int"
    def put(name, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    put("1", [("p", "a.py", "a.py", "x = 1\n", "x = 2\n", False, 1), ("p", "a.py", "a.py", "x = 1\n", "x = 3\n", False, 2), ("q", "a.txt", "a.txt", "1", "2", False, 1)])
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    diff_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    put("2", [("p", "a.py", "a.py", "x = 1\n", "x = 1\n", False, 3)])
    diff_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r.pair_id: r for r in read_latest(spark, str(tmp_path / "out")).collect()}
    assert rows["p"].actions == [] and rows["p"].epoch > rows["q"].epoch and rows["q"].mode == "language"


def test_counterparts_of_moves_and_rows_that_changed(spark):
    from palimpsest.operators import diff as P

    src = "def a(x):\n    return x + 1\n\nclass K:\n    def m(self):\n        return 2\n"
    dst = "class K:\n    def m(self):\n        return 2\n\ndef a(x):\n    return x + 1\n"
    found = P.diff(spark.createDataFrame([("p", "a.py", "a.py", src, dst, False)], P.PAIRS)).cache()
    actions, grid = P.actions(found), P.alignment(found)
    lines = []
    for side, text in (("left", src), ("right", dst)):
        at = 0
        for k, line in enumerate(text.split("\n")):
            lines.append(("p", side, k, at, len(line.encode())))
            at += len(line.encode()) + 1
    table = spark.createDataFrame(lines, "pair_id string, side string, line_no int, start_byte int, n_bytes int")
    rows = V.move_counterparts(actions, table, grid, ["pair_id"]).collect()
    texts = {"left": dst.split("\n"), "right": src.split("\n")}
    assert {(r.from_side, texts[r.from_side][r.line], r.col) for r in rows} in ({("left", "class K:", 0), ("right", "class K:", 0)}, {("left", "def a(x):", 0), ("right", "def a(x):", 0)})
    assert all(r.grid_row is not None for r in rows)
    tints = V.line_tints(P.highlight_spans(found).withColumn("size", V.F.col("end_col") - V.F.col("start_col")), ["pair_id"])
    changed = V.change_rows(grid, tints, ["pair_id"])
    assert changed.count() == grid.count() and changed.where("changed").count() >= 2
    told = {(r.seq, r.field): r.value for r in V.details(actions, table, ["pair_id"]).collect()}
    moved = actions.where("action = 'move'").first()
    assert told[moved.seq, "action"] == "MOVE" and told[moved.seq, "range"] in ("L4:1 - L6:17", "L1:1 - L2:17") and (moved.seq, "new range") in told
    ends = spark.createDataFrame([("p", "left", 0, 3), ("p", "left", 4, 999)], "pair_id string, side string, start_byte int, end_byte int")
    assert sorted(r.range for r in V.range_texts(ends, table, ["pair_id"]).collect()) == ["L1:1 - L1:4", "L1:5 - L7:1"]
    assert all("MOVE" in r.preview for r in V.preview(actions.where("action = 'move'"), ["pair_id"]).collect())


def test_nearest_ancestors_against_parents(spark):
    df = spark.createDataFrame([(k, f"<div><p>a{k}<b>c</b></p><ul><li>x<i>y</i></ul></div><p>z") for k in range(5)], "key long, text string")
    nodes = T.nodes(df, "html")
    rows = {(r.key, r.node_id): r for r in nodes.collect()}
    for r in N.nearest_ancestor(nodes, "type = 'element' AND label != 'b'").collect():
        p = rows[r.key, r.node_id].parent_id
        while p >= 0 and not (rows[r.key, p].type == "element" and rows[r.key, p].label != "b"):
            p = rows[r.key, p].parent_id
        assert r.ancestor_id == (p if p >= 0 else None)
