"""Comparison of pairs as a whole: gates, invariants, alignment, highlights and the JSON."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import diff as P
from palimpsest.operators import gridalign as A
from palimpsest.operators import highlight as H
from palimpsest.operators.treematch import Matching
from palimpsest.plans.queries import CODE
from palimpsest.sources.rules import BY_EXTENSION, LANGUAGES, detect

PY = "def a(x):\n    # note one\n    return x + 1\n\nclass K:\n    def m(self):\n        if self.x:\n            y = 1\n        return y\n"
PY2 = "class K:\n    def m(self, z):\n        return y\n\n    def new(self):\n        pass\n\ndef a(x):\n    # note two\n    return x + 2\n"
lines = st.lists(st.sampled_from(["def f():", "    return 1", "    return 2", "x = 1", "# c", "    # d", "", "class A:", "    y = [1, 2]", "é = 'ü'"]), max_size=12).map("\n".join)


def whole(src, dst, lang="python", **options):
    return P.compare_row(src, dst, "tree", lang, lang, P.Options(**options))


def covered(rows, src, dst):
    """Every line of both sides stands once."""
    left = sorted(r["left_line"] for r in rows if r["left_line"] >= 0)
    right = sorted(r["right_line"] for r in rows if r["right_line"] >= 0)
    if not src and not dst:
        return (left, right) == ([], [0])
    return left == (list(range(src.count("\n") + 1)) if src else []) and right == (list(range(dst.count("\n") + 1)) if dst else [])


@settings(max_examples=150, deadline=None)
@given(lines, lines)
def test_invariants(src, dst):
    row = whole(src, dst, error_fallback=False)
    assert covered(row["alignment"], src, dst)
    kinds = {a["action"] for a in row["actions"]}
    if src == dst:
        assert not row["actions"] and all(r["left_line"] == r["right_line"] for r in row["alignment"] if src)  # an empty pair is one filler
    if not src:
        assert kinds <= {"insert"}
    if not dst:
        assert kinds <= {"delete"}
    raw = {"before": src.encode(), "after": dst.encode()}
    for a in row["actions"]:
        n = a["node"]
        assert n["tree"] == ("after" if a["action"] == "insert" else "before") and 0 <= n["start_byte"] <= n["end_byte"] <= len(raw[n["tree"]])
        if a["origin"] == "comment" and n["label"]:
            assert raw[n["tree"]][n["start_byte"] : n["end_byte"]].decode() == n["label"]
    for side, text in (("left", src), ("right", dst)):
        sizes = [len(x.encode()) for x in text.split("\n")]
        assert all(0 <= s["start_col"] < s["end_col"] <= sizes[s["line"]] for s in row[f"{side}_highlights"])
    assert len({p["src_id"] for p in row["mappings"]}) == len({p["dst_id"] for p in row["mappings"]}) == len(row["mappings"])


def test_moved_class_changed_comment_and_value():
    row = whole(PY, PY2)
    told = {(a["action"], a["origin"], a["node"]["type"]) for a in row["actions"]}
    assert {("move", "tree", "class_declaration"), ("update", "comment", "comment"), ("update", "tree", "number"), ("delete", "tree", "if_statement"), ("insert", "tree", "function_declaration")} <= told
    a, b = PY.split("\n"), PY2.split("\n")
    pairs = [(a[r["left_line"]], b[r["right_line"]]) for r in row["alignment"] if min(r["left_line"], r["right_line"]) >= 0]
    assert ("class K:", "class K:") in pairs or ("def a(x):", "def a(x):") in pairs


def test_options():
    assert whole(PY, PY2, actions=True)["alignment"] is None
    assert whole(PY, PY2, alignment=True)["actions"] is None
    assert not any(a["origin"] == "comment" for a in whole(PY, PY2, ignore_comments=True)["actions"])
    broken = whole("def f(:\n  )(\n", "x = 1\n")
    assert broken["mode"] == "errors" and broken["errors"][0] > 0 and all(a["origin"] == "line" for a in broken["actions"])
    assert whole("def f(:\n  )(\n", "x = 1\n", parse_error_limit=9)["mode"] == "tree"
    other = {**LANGUAGES, "python": P.Rules("python", ("py",), style="indent", line_comments=("#",), keywords=frozenset())}
    assert P.compare_row(PY, PY2, "tree", "python", "python", rules=other)["mode"] == "tree"


def test_only_a_comment_changes():
    row = whole("x = 1  # a note of some length\n", "x = 1  # a note of other length\n")
    assert [(a["action"], a["origin"]) for a in row["actions"]] == [("update", "comment")]
    assert not whole("x = 1  # a\n", "x = 1  # b\n", ignore_comments=True)["actions"]


@pytest.mark.parametrize("ext", sorted(CODE))
def test_every_builder_reads_its_language(ext):
    form = CODE[ext].split("%d")
    one = lambda k, v: form[0] + str(k) + "".join(f + str(x) for f, x in zip(form[1:-1], ([k] if len(form) == 4 else []) + [v], strict=True)) + form[-1]
    src, dst = "".join(one(k, 100 + k) for k in range(9)), "".join(one(k, 200 + k if k == 4 else 100 + k) for k in range(9) if k != 6)
    row = whole(src, dst, BY_EXTENSION[ext])
    assert row["mode"] == "tree" and row["errors"] == [0, 0]
    tree = [a for a in row["actions"] if a["origin"] == "tree"]
    assert sorted((a["action"], a.get("old_value")) for a in tree if a["action"] == "update") == [("update", "104")]
    assert [a["action"] for a in tree if a["action"] != "update"] == ["delete"] and all(a["subtree"] for a in tree if a["action"] == "delete")


def test_names_of_files():
    known = "test.go test.py test.js test.ts test.tsx test.jsx test.rs test.c test.cpp test.hpp test.cc test.cxx test.hh test.h test.cs test.java test.php test.rb test.json test.yaml test.yml test.html test.css test.lua test.zig test.sh test.bash".split()
    assert all(detect(n) for n in known) and not detect("test.xyz") and not detect("test") and not detect("a.py/test") and detect("a\\b.PY") == "python"


def weight(w, grid):
    return sum(int(w.weights(i, j, j + 1)[0]) for i, j in grid if min(i, j) >= 0)


def test_halved_regions_weigh_the_same(monkeypatch):
    pick = random.Random(4)
    for _ in range(30):
        left, right = ([pick.choice("abcdefgh") for _ in range(pick.randrange(1, 40))] for _ in range(2))
        w = A._Lines(left, right, None, [])
        full = A._heaviest(w, 0, len(left), 0, len(right))
        monkeypatch.setattr(A, "MAX_CELLS", 20)
        halved = A._heaviest(w, 0, len(left), 0, len(right))
        monkeypatch.undo()
        assert weight(w, full) == weight(w, halved)
        assert sorted(i for i, _ in halved if i >= 0) == list(range(len(left))) and sorted(j for _, j in halved if j >= 0) == list(range(len(right)))


def test_side_by_side():
    grid = [(0, 0), (1, -1), (2, -1), (-1, 1), (3, 2), (-1, 3)]
    assert A.side_by_side(grid, ["a", "b", "c", "/*"], set(), set()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert A.side_by_side(grid, ["a", "b", "c", "d"], set(), set()) == [(0, 0), (1, 1), (2, -1), (3, 2), (-1, 3)]
    assert A.side_by_side(grid[:4], ["a", "b", "c"], {1}, set()) == [(0, 0), (1, -1), (2, 1)]


def test_empty_sides_are_filler():
    assert A.align("", "a\nb") == [(-1, 0), (-1, 1)] and A.align("a\nb", "") == [(0, -1), (1, -1)] and A.align("", "") == [(-1, 0)]


def test_span_pieces_and_merging():
    raw = "ab\ncdé\n\nf".encode()
    starts = H.line_starts(raw)
    for start in range(len(raw) + 1):
        for end in range(start, len(raw) + 1):
            cells = {}
            for k in range(start, end):
                if raw[k : k + 1] != b"\n":
                    line = max(i for i, s in enumerate(starts) if s <= k)
                    cells.setdefault(line, []).append(k - starts[line])
            assert H.pieces(start, end, starts, len(raw)) == [(i, c[0], c[-1] + 1) for i, c in sorted(cells.items())]
    text = b"foo, bar = baz"
    def spans(*marks):
        return [s[1:4] for s in H.highlights(text, [H.Mark(a, b, kind, k, b - a) for k, (a, b, kind) in enumerate(marks)])]

    assert spans((0, 3, "insert"), (5, 8, "insert")) == [(0, 8, "insert")]
    assert spans((5, 8, "insert"), (11, 14, "insert")) == [(5, 8, "insert"), (11, 14, "insert")]  # a sign lies between
    assert spans((0, 3, "move"), (5, 8, "insert")) == [(0, 3, "move"), (5, 8, "insert")]
    assert spans((0, 8, "delete"), (0, 3, "delete")) == [(0, 3, "delete"), (0, 8, "delete")]
    assert H.highlights(b"", []) == []


def test_tables_and_json(spark):
    rows = [("a", "x.py", "x.py", PY, PY2, False), ("b", "x.txt", "y", "1\n2\n3", "1\n3\n4\n5", False), ("c", "x.py", "x.py", PY, PY, False), ("d", "x.json", "x", '{"a": 1}', '{"a": 2}', True), ("e", "x.py", "y", None, PY, False)]
    found = P.diff(spark.createDataFrame(rows, P.PAIRS)).cache()
    modes = {r.pair_id: r.mode for r in found.select("pair_id", "mode").collect()}
    assert modes == {"a": "tree", "b": "language", "c": "tree", "d": "conflict", "e": "tree"}
    parsed = {r.pair_id: json.loads(r.envelope) for r in P.envelope(found).collect()}
    assert all(p["version"] == "v1" for p in parsed.values()) and "actions" not in parsed["c"] and "left_highlights" not in parsed["e"]
    assert parsed["b"]["line_alignment"] == [[0, 0], [1, -1], [2, 1], [-1, 2], [-1, 3]]
    assert [(a["action"], a["node"]["start_byte"], a["node"]["end_byte"]) for a in parsed["b"]["actions"]] == [("delete", 2, 4), ("insert", 4, 6), ("insert", 6, 7)]
    assert parsed["b"]["right_highlights"] == [[2, 0, 1, "insert"], [3, 0, 1, "insert"]]
    assert P.actions(found).where("pair_id = 'a'").count() == len(parsed["a"]["actions"])
    assert P.alignment(found).where("pair_id = 'a'").count() == len(parsed["a"]["line_alignment"])
    assert P.highlight_spans(found).where("pair_id = 'a' AND side = 'left'").count() == len(parsed["a"]["left_highlights"])
    assert P.mappings(found).where("pair_id = 'c'").count() > 10
    assert any(r.line.startswith("UPDATE number") and r.line.endswith("1 -> 2") for r in P.printed(found).collect())
    assert P.diff(spark.createDataFrame([], P.PAIRS)).count() == 0


def test_files_of_two_folders(spark, tmp_path):
    for side, files in (("old", {"p/a.py": PY, "gone.txt": "x"}), ("new", {"p/a.py": PY2, "more.txt": "y"})):
        for name, text in files.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_text(text)
    pairs = P.pairs_of_files(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    found = P.diff(pairs)
    assert {(r.pair_id, r.mode) for r in found.collect()} == {("p/a.py", "tree"), ("gone.txt", "language"), ("more.txt", "language")}
    P.write_envelopes(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_matching_is_one_to_one_after_clean_up():
    m, _ = P.compare(PY, PY2, "python")
    assert isinstance(m, Matching) and all(m.back[y] == x for x, y in enumerate(m.to) if y >= 0)


def test_files_of_any_bytes(spark, tmp_path):
    """Latin-1, UTF-16, binary and one-sided files give a row each, and are compared by lines; texts keep their trees."""
    files = {"a.py": (b"x = 1\n", b"x = 2\n"), "latin.py": ("é = 1\n".encode("latin-1"), "é = 2\né\n".encode("latin-1")), "wide.py": ("x = 1\n".encode("utf-16"), "x = 1\ny\n".encode("utf-16")), "image.json": (b"\x00\x01\xff\n", b"\x00\x02\n"), "only.py": (None, b"y = \xe9\n")}
    for name, sides in files.items():
        for folder, content in zip(("old", "new"), sides, strict=True):
            (tmp_path / folder).mkdir(exist_ok=True)
            if content is not None:
                (tmp_path / folder / name).write_bytes(content)
    pairs = P.pairs_of_files(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    found = {r.pair_id: r for r in P.diff(pairs).collect()}
    assert {k: r.mode for k, r in found.items()} == {"a.py": "tree", "latin.py": "bytes", "wide.py": "bytes", "image.json": "bytes", "only.py": "bytes"}
    assert [a.action for a in found["latin.py"].actions] == ["insert"] and len(P.envelope(P.diff(pairs)).collect()) == 5
