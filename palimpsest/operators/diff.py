"""Comparison of pairs of texts: the gates, the tree or line mode, and every table of the result.

``diff`` takes pairs and gives one row a pair, computed by one Arrow kernel
with nothing shuffled; ``actions``, ``alignment``, ``highlights`` and
``mappings`` are its parts as tables, ``envelope`` is the JSON of a row.

A pair is compared by lines if it is a conflict or holds conflict markers, if
a side is larger than the limit, if the language of neither side is known, or
if a side has more parse errors than allowed; else by trees.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.parsing import errors_in, parse
from ..sources.rules import LANGUAGES, Rules, language_of
from . import comments
from .editscript import script
from .edits import Edit, clean, from_script
from .gridalign import align
from .highlight import Mark, highlights, line_starts
from .spread import spread
from .treematch import Matching, Partition, match

VERSION = "v1"
#: Characters of compared texts, and pairs, after which a result batch ends.
OUT_CHARS = 64_000
OUT_PAIRS = 64
#: Characters of pairs compared by lines, after which a result batch ends.
LINE_CHARS = 500_000


@dataclass(frozen=True)
class Options:
    parse_error_limit: int = 0
    error_fallback: bool = True
    size_limit: bool = True
    ignore_comments: bool = False
    #: Sections of the result; none means all.
    actions: bool = False
    alignment: bool = False
    highlights: bool = False
    #: Whether the pairs of matched nodes leave the tasks as well.
    mappings: bool = True
    #: Fields of the actions that leave the tasks; by default all but ``place``, the lines and columns of the node.
    fields: tuple[str, ...] | None = None

    def sections(self) -> tuple[bool, bool, bool]:
        chosen = (self.actions, self.alignment, self.highlights)
        return chosen if any(chosen) else (True, True, True)


PAIRS = "pair_id string, src_name string, dst_name string, src string, dst string, is_conflict boolean"
NODE = "struct<tree: string, type: string, label: string, start_byte: int, end_byte: int>"
ACTION_FIELDS = {
    "action": "string", "origin": "string", "node": NODE, "parent": NODE, "position": "int", "old_parent": NODE, "old_position": "int",
    "old_value": "string", "new_value": "string", "subtree": "boolean", "dest_node": NODE, "dest_start_byte": "int", "dest_end_byte": "int", "group_id": "string", "src_id": "int", "dst_id": "int",
}
PLACE = "struct<start_line: int, start_col: int, end_line: int, end_col: int>"
SPANS = "array<struct<line: int, start_col: int, end_col: int, action: string, seq: int>>"


def row_of(fields: tuple[str, ...] | None = None) -> str:
    """Columns of a result whose actions have these fields."""
    known = ACTION_FIELDS | {"place": PLACE}
    action = ", ".join(f"{name}: {known[name]}" for name in fields or ACTION_FIELDS)
    return f"""mode string, lang string, actions array<struct<{action}>>, alignment array<struct<left_line: int, right_line: int>>,
    left_highlights {SPANS}, right_highlights {SPANS}, mappings array<struct<src_id: int, dst_id: int>>, errors array<int>"""


ROW = row_of()


def gated(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """``pairs`` with ``lang`` (of the source, else of the destination) and ``mode``: ``tree``, or the gate that says lines.

    A column ``plain`` that is false (a side is no valid text) says so too.
    """
    src, dst = F.coalesce(F.col("src"), F.lit("")), F.coalesce(F.col("dst"), F.lit(""))
    large = (F.octet_length(src) > X.SIZE_LIMIT) | (F.octet_length(dst) > X.SIZE_LIMIT) if options.size_limit else F.lit(False)
    left, right = language_of("src_name"), language_of("dst_name")
    mode = (
        F.when(F.coalesce(F.col("is_conflict"), F.lit(False)) | X.has_conflict(src) | X.has_conflict(dst), "conflict")
        .when(large, "size").when(~F.coalesce(F.col("plain"), F.lit(True)) if "plain" in pairs.columns else F.lit(False), "bytes").when(left.isNull() & right.isNull(), "language").otherwise("tree")
    )
    return pairs.withColumns({"src": src, "dst": dst, "lang": F.coalesce(left, right), "dst_lang": F.coalesce(right, left), "mode": mode})


def compare(src: str, dst: str, lang: str, dst_lang: str | None = None, options: Options = Options(), rules: Mapping[str, Rules] = LANGUAGES):
    """(matching, edits) of two texts, or the two error counts if they are too many."""
    a, b = parse(src, lang, rules), parse(dst, dst_lang or lang, rules)
    if options.error_fallback and max(a.errors, b.errors) > options.parse_error_limit:
        return a.errors, b.errors
    m = match(a, b, rules[lang], Partition(src, dst, a, b))
    edits = from_script(m, script(m))
    if not options.ignore_comments:
        edits += comments.compare(a.comments, b.comments)
    return m, clean(m, edits)


# -- rows of the result ------------------------------------------------------------


def _node(tree: str, span, end: int | None = None):
    return None if span is None else {"tree": tree, "type": span.kind, "label": span.label or None, "start_byte": span.start, "end_byte": span.end if end is None else end}


def _header_end(m: Matching, side: str, i: int) -> int | None:
    """Where the first block below a node begins: without its block, a node is its head."""
    t = m.b if side == "after" else m.a
    return next((t.start[c] for c in t.children[i] if t.kind[c] in m.rules.blocks), None)


def _tree_node(m: Matching, side: str, i: int):
    t = m.b if side == "after" else m.a
    return None if i < 0 else {"tree": side, "type": t.kind[i], "label": t.label[i] or None, "start_byte": t.start[i], "end_byte": t.end[i]}


def action_row(m: Matching, e: Edit) -> dict:
    """An edit as a row of the result."""
    row = {"action": e.action, "origin": e.origin, "group_id": e.group, "src_id": e.src if e.src >= 0 else None, "dst_id": e.dst if e.dst >= 0 else None, "subtree": e.subtree or None}
    side, span = ("after", e.right) if e.action == "insert" else ("before", e.left)
    tree = e.origin == "tree"
    short = _header_end(m, side, e.node[1]) if tree and e.action in ("insert", "delete") and not e.subtree else None
    row["node"] = _node(side, span, short)
    if e.action in ("insert", "delete"):
        t = m.b if side == "after" else m.a
        row["parent"] = _tree_node(m, side, t.parent[e.node[1]]) if tree else None
        row["position"] = e.position
    elif e.action == "update":
        row |= {"old_value": e.old_value, "new_value": e.new_value, "dest_node": _node("after", e.right)}
    else:
        row["dest_node"] = _node("after", e.right)
        row |= {"dest_start_byte": e.right.start, "dest_end_byte": e.right.end, "position": e.position}
        if tree:
            row |= {"parent": _tree_node(m, "after", m.b.parent[e.dst]), "old_parent": _tree_node(m, "before", m.a.parent[e.src]), "old_position": m.a.place[e.src]}
    return row


def marks(rows: list[dict], side: str) -> list[Mark]:
    """What each action colours on one side."""
    out = []
    for k, r in enumerate(rows):
        node, dest = r.get("node"), r.get("dest_node")
        if side == "left":
            span = node if r["action"] != "insert" else None
        else:
            span = node if r["action"] == "insert" else dest if r["action"] in ("update", "move") else None
        if span is None:
            continue
        ranges = [(p["start_byte"], p["end_byte"]) if (p := r.get(name)) else None for name in ("parent", "old_parent")]
        out.append(Mark(span["start_byte"], span["end_byte"], r["action"], k, span["end_byte"] - span["start_byte"], r.get("group_id"), *ranges))
    return out


def line_rows(src: bytes, dst: bytes, grid: list[tuple[int, int]]) -> list[dict]:
    """Lines that face a filler, as deletes and inserts of whole lines with their ends."""
    starts = {"before": [*line_starts(src), len(src)], "after": [*line_starts(dst), len(dst)]}
    out = []
    for i, j in grid:
        if (i < 0) == (j < 0):
            continue
        side, k = ("before", i) if j < 0 else ("after", j)
        out.append({"action": "delete" if j < 0 else "insert", "origin": "line", "node": {"tree": side, "type": "", "label": None, "start_byte": starts[side][k], "end_byte": starts[side][k + 1]}})
    return out


def place_of(starts: list[int], node: dict) -> dict:
    """Lines and columns, from 0, of both ends of a node; ``starts`` are the beginnings of all lines of its side."""
    (i, p), (j, q) = ((bisect_right(starts, at) - 1, at) for at in (node["start_byte"], node["end_byte"]))
    return {"start_line": i, "start_col": p - starts[i], "end_line": j, "end_col": q - starts[j]}


def compare_row(src: str, dst: str, mode: str, lang: str | None, dst_lang: str | None, options: Options = Options(), rules: Mapping[str, Rules] = LANGUAGES) -> dict:
    """All parts of the result of one pair."""
    want_actions, want_alignment, want_highlights = options.sections()
    m, errors, edits = None, None, []
    if mode == "tree":
        found = compare(src, dst, lang, dst_lang, options, rules)
        if isinstance(found[0], Matching):
            m, edits = found
            errors = [m.a.errors, m.b.errors]
        else:
            mode, errors = "errors", list(found)
    raw = src.encode(), dst.encode()
    grid = align(src, dst, m, edits) if want_alignment or m is None else []
    rows = [action_row(m, e) for e in edits] if m is not None else line_rows(*raw, grid)
    if "place" in (options.fields or ()):
        starts = {"before": line_starts(raw[0]), "after": line_starts(raw[1])}
        for r in rows:
            r["place"] = place_of(starts[r["node"]["tree"]], r["node"])
    out = {"mode": mode, "lang": lang, "errors": errors, "mappings": None if not options.mappings else [] if m is None else [{"src_id": x, "dst_id": int(y)} for x, y in enumerate(m.to) if y >= 0]}
    out["actions"] = rows if want_actions else None
    out["alignment"] = [{"left_line": i, "right_line": j} for i, j in grid] if want_alignment else None
    for side, text in zip(("left", "right"), raw, strict=True):
        found = highlights(text, marks(rows, side)) if want_highlights else None
        out[f"{side}_highlights"] = None if found is None else [dict(zip(("line", "start_col", "end_col", "action", "seq"), s, strict=True)) for s in found]
    return out


def diff(pairs: DataFrame, options: Options = Options(), rules: Mapping[str, Rules] = LANGUAGES, key: str = "pair_id", dealt: bool = True) -> DataFrame:
    """``pairs`` (key, src_name, dst_name, src, dst, is_conflict) to one row a pair with all parts of its result.

    Null texts are empty.  A pair is one unit of work; rows are given out when the
    texts of a few are compared, so memory follows the largest pair.  Pairs are dealt
    to all tasks by their key, unless ``dealt`` says that they lie well as they are.
    """
    found = gated(pairs, options).select(key, "src", "dst", "mode", "lang", "dst_lang")
    found = spread(found, key) if dealt else found
    kind = f"`{key}` {found.schema[key].dataType.simpleString()}, {row_of(options.fields)}"
    arrow = _arrow(found.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        # Rows of lines are built by columns where they have all of them.
        by_rows = options.fields is not None
        plain = _LineRows(arrow, options)
        for batch in batches:
            for k, src, dst, mode, lang, dst_lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mode == "tree" or by_rows:
                    held.append({key: k, **compare_row(src, dst, mode, lang, dst_lang, options, rules)})
                    size += len(src) + len(dst)
                    if size >= OUT_CHARS or len(held) == OUT_PAIRS:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                else:
                    plain.add(k, src, dst, mode, lang)
                    if plain.chars >= LINE_CHARS:
                        yield plain.batch()
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
        if plain.chars:
            yield plain.batch()

    return found.mapInArrow(run, kind)


def modes(pairs: DataFrame, options: Options = Options(), rules: Mapping[str, Rules] = LANGUAGES, key: str = "pair_id", dealt: bool = True) -> DataFrame:
    """(key, mode, lang, errors) as :func:`diff` gives them.  Only gates and parse errors decide, so nothing is matched."""
    found = gated(pairs, options).select(key, "src", "dst", "mode", "lang", "dst_lang")
    found = spread(found, key) if dealt else found
    kind = f"`{key}` {found.schema[key].dataType.simpleString()}, mode string, lang string, errors array<int>"
    arrow = _arrow(found.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [])
            for _, src, dst, mode, lang, dst_lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                errors = None
                if mode == "tree":
                    errors = [errors_in(src, lang, rules), errors_in(dst, dst_lang or lang, rules)]
                    if options.error_fallback and max(errors) > options.parse_error_limit:
                        mode = "errors"
                out[0].append(mode)
                out[1].append(errors)
            given = [batch.column(0), pa.array(out[0], pa.string()), batch.column(4), pa.array(out[1], arrow.field("errors").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(given, arrow, strict=True)], schema=arrow)

    return found.mapInArrow(run, kind)


class _LineRows:
    """Rows of pairs compared by lines, as :func:`compare_row` gives them, built column by column."""

    def __init__(self, schema: pa.Schema, options: Options):
        self.schema = schema
        self.want_actions, self.want_alignment, self.want_highlights = options.sections()
        self.mappings = options.mappings
        self.clear()

    def clear(self) -> None:
        self.chars = 0
        self.known: list[tuple] = []
        self.actions: tuple[list, ...] = ([], [], [], [])
        self.grid: tuple[list, list] = ([], [])
        self.spans: dict[str, tuple[list, ...]] = {side: ([], [], [], []) for side in ("left", "right")}
        #: Where the rows of each pair end in the lists above.
        self.ends: dict[str, list[int]] = {name: [0] for name in ("actions", "alignment", "left_highlights", "right_highlights")}

    def add(self, key, src: str, dst: str, mode: str, lang: str | None) -> None:
        grid = align(src, dst)
        self.known.append((key, mode, lang))
        self.chars += len(src) + len(dst) + 1
        if self.want_alignment:
            self.grid[0].extend(i for i, _ in grid)
            self.grid[1].extend(j for _, j in grid)
        if self.want_actions or self.want_highlights:
            raw = src.encode(), dst.encode()
            starts = [[*line_starts(x), len(x)] for x in raw]
            names, trees, firsts, lasts = self.actions
            seq = 0
            for i, j in grid:
                if i >= 0 and j >= 0:
                    continue
                side, k = (0, i) if j < 0 else (1, j)
                at = starts[side]
                start, end, action = at[k], at[k + 1], ("delete", "insert")[side]
                if self.want_actions:
                    names.append(action)
                    trees.append(("before", "after")[side])
                    firsts.append(start)
                    lasts.append(end)
                size = end - start - (k + 2 < len(at))  # without the line's end
                if self.want_highlights and size:
                    lines, sizes, marked, edits = self.spans[("left", "right")[side]]
                    lines.append(k)
                    sizes.append(size)
                    marked.append(action)
                    edits.append(seq)
                seq += 1
        self.ends["actions"].append(len(self.actions[0]))
        self.ends["alignment"].append(len(self.grid[0]))
        for side in ("left", "right"):
            self.ends[f"{side}_highlights"].append(len(self.spans[side][0]))

    def batch(self) -> pa.RecordBatch:
        n = len(self.known)

        def struct(kind: pa.StructType, size: int, given: dict) -> pa.Array:
            parts = [given[f.name] if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in kind]
            return pa.StructArray.from_arrays(parts, fields=list(kind))

        def lists(name: str, wanted: bool, given: dict) -> pa.Array:
            kind, ends = self.schema.field(name).type, self.ends[name]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct(kind.value_type, ends[-1], given), type=kind) if wanted else pa.nulls(n, kind)

        keys, modes, langs = zip(*self.known, strict=True)
        action, tree, start, end = self.actions
        node = self.schema.field("actions").type.value_type.field("node").type
        nodes = struct(node, len(action), {"tree": tree, "type": [""] * len(action), "start_byte": start, "end_byte": end})
        columns = {
            self.schema.names[0]: keys, "mode": modes, "lang": langs, "errors": [None] * n, "mappings": [[] if self.mappings else None] * n,
            "actions": lists("actions", self.want_actions, {"action": action, "origin": ["line"] * len(action), "node": nodes}),
            "alignment": lists("alignment", self.want_alignment, {"left_line": self.grid[0], "right_line": self.grid[1]}),
        }
        for side, (line, size, marked, seq) in self.spans.items():
            columns[f"{side}_highlights"] = lists(f"{side}_highlights", self.want_highlights, {"line": line, "start_col": [0] * len(line), "end_col": size, "action": marked, "seq": seq})
        out = pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in self.schema], schema=self.schema)
        self.clear()
        return out


def _arrow(spark: SparkSession, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def actions(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row for every action, in order."""
    return found.select(key, F.posexplode("actions").alias("seq", "a")).select(key, "seq", "a.*")


def alignment(found: DataFrame, key: str = "pair_id") -> DataFrame:
    return found.select(key, F.posexplode("alignment").alias("grid_row", "r")).select(key, "grid_row", "r.*")


def highlight_spans(found: DataFrame, key: str = "pair_id") -> DataFrame:
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_highlights").alias("spans")) for s in ("left", "right")))
    return found.select(key, F.explode(sides).alias("s")).select(key, "s.side", F.explode("s.spans").alias("h")).select(key, "side", "h.*")


def mappings(found: DataFrame, key: str = "pair_id") -> DataFrame:
    return found.select(key, F.explode("mappings").alias("p")).select(key, "p.*")


def _tuples(spans: str) -> Column:
    """Spans as tuples; numbers and texts stand in one list, which has no type of its own."""
    return F.concat(F.lit("["), F.array_join(F.transform(spans, lambda s: F.concat(F.lit("["), F.concat_ws(",", s["line"], s["start_col"], s["end_col"]), F.lit(',"'), s["action"], F.lit('"]'))), ","), F.lit("]"))


def envelope(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, envelope): the versioned JSON of each row; empty sections are left out, and a missing ``subtree`` is false."""
    rows = F.transform("actions", lambda a: a.dropFields("origin", "src_id", "dst_id"))
    grid = F.transform("alignment", lambda r: F.array(r["left_line"], r["right_line"]))
    parts = [F.lit(f'"version":"{VERSION}"')]
    for name, value, size in (
        ("actions", F.to_json(rows), F.size("actions")), ("line_alignment", F.to_json(grid), F.size("alignment")),
        ("left_highlights", _tuples("left_highlights"), F.size("left_highlights")), ("right_highlights", _tuples("right_highlights"), F.size("right_highlights")),
    ):
        parts.append(F.when(size > 0, F.concat(F.lit(f'"{name}":'), value)))
    return found.select(key, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("envelope"))


# -- text ---------------------------------------------------------------------------


def action_text(rows: DataFrame) -> Column:
    """An action in words."""
    def node(name: str) -> Column:
        label = F.when(F.col(f"{name}.label").isNotNull(), F.concat(F.lit(' "'), F.col(f"{name}.label"), F.lit('"'))).otherwise("")
        return F.concat(F.col(f"{name}.type"), label, F.format_string(" [%d-%d]", F.col(f"{name}.start_byte"), F.col(f"{name}.end_byte")))

    into = F.when(F.col("parent").isNotNull(), F.concat(F.lit(" into "), node("parent"), F.format_string(" at %d", "position"))).otherwise("")
    what = F.when(F.col("action") == "update", F.concat(F.lit(": "), F.coalesce("old_value", F.lit("")), F.lit(" -> "), F.coalesce("new_value", F.lit("")))).when(F.col("action").isin("insert", "move"), into).otherwise("")
    return F.concat(F.upper("action"), F.lit(" "), node("node"), F.when(F.col("subtree"), " (subtree)").otherwise(""), what)


def printed(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, seq, line): the actions of each pair as text."""
    rows = actions(found, key)
    return rows.select(key, "seq", action_text(rows).alias("line"))


def printed_mappings(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, line): the mapping of each pair as text, by source node."""
    rows = mappings(found, key)
    return rows.orderBy(key, "src_id").select(key, F.format_string("%d -> %d", "src_id", "dst_id").alias("line"))


def texts_of(pairs: DataFrame) -> DataFrame:
    """Pairs of bytes (src, dst) as pairs of texts, with ``plain``: whether both sides are valid UTF-8 without NUL.  A missing side is empty."""
    sides = [F.coalesce(F.col(c), F.lit(b"")) for c in ("src", "dst")]
    return pairs.withColumns({"plain": X.is_plain(sides[0]) & X.is_plain(sides[1]), "src": X.as_text(sides[0]), "dst": X.as_text(sides[1])})


def pairs_of_files(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Pairs of the files of two folders with equal paths below them; a file on one side alone faces an empty text.

    The paths go to Spark's own reader, so they may be in any store it reads.
    Files are read as bytes: those that are no UTF-8 text are compared by lines, a character for each byte.
    """
    def side(folder: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        base = folder.rstrip("/").rpartition("/")[2]
        path = F.substring_index("path", f"/{base}/", -1)
        return files.select(path.alias("pair_id"), F.col("content").alias(name))

    both = side(left, "src").join(side(right, "dst"), "pair_id", "full")
    return texts_of(both.select("pair_id", F.col("pair_id").alias("src_name"), F.col("pair_id").alias("dst_name"), "src", "dst", F.lit(False).alias("is_conflict")))


def write_envelopes(found: DataFrame, path: str, key: str = "pair_id") -> None:
    """One JSON document a line, beside its key."""
    envelope(found, key).write.json(path)
