"""What a side-by-side view shows, as tables: visible rows, tints, layers, search, positions and texts.

Rows carry the keys of their pair.  ``spans`` has (keys, side, line, start_col,
end_col, action, seq, size): highlights with the bytes of the node behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I

#: Which of two highlights of one size shows.
PRIORITY = {"update": 4, "insert": 3, "move": 2, "delete": 1}
TAB = "    "
#: Endings of types that say nothing.
_ENDINGS = "_(?:declaration|definition|statement|expression|literal|clause|item|spec)$"
#: Types with a shorter name.
_NAMES = {"function_definition": "function", "class_declaration": "class", "parenthesized": "brackets", "bracketed": "list", "object": "object", "pair": "entry"}


def virtual_lines(grid: DataFrame, folds: DataFrame, keys: list[str], row: str = "grid_row") -> DataFrame:
    """Visible rows (keys, virtual_row, row, fold_start, fold_end): a closed fold shows as one row without a grid row.

    ``folds`` has (keys, start_row, end_row) and may have ``open``; open folds show their rows.
    """
    if "open" in folds.columns:
        folds = folds.where(~F.col("open"))
    hidden = folds.select(*keys, "start_row", F.explode(F.sequence("start_row", "end_row")).alias(row), "end_row")
    rows = grid.join(hidden, [*keys, row], "left").where(f"start_row IS NULL OR `{row}` = start_row")
    order = Window.partitionBy(*keys).orderBy(row)
    shown = F.when(F.col("start_row").isNull(), F.col(row))
    return rows.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("virtual_row"), shown.cast("long").alias("row"), F.col("start_row").alias("fold_start"), F.col("end_row").alias("fold_end"))


def virtual_row_of(lines: DataFrame, rows: DataFrame, keys: list[str], row: str = "grid_row") -> DataFrame:
    """(keys, row, virtual_row): where grid rows show; rows in a closed fold show as its marker."""
    shown = lines.select(*keys, F.explode(F.sequence(F.coalesce("row", "fold_start"), F.coalesce("row", "fold_end"))).alias(row), "virtual_row")
    return rows.select(*keys, row).join(shown, [*keys, row]).select(*keys, row, "virtual_row")


def expand_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit(TAB))


def visual_column(line: Column, byte: Column) -> Column:
    """Column of a byte of a line when tabs take four places."""
    return byte + (len(TAB) - 1) * _tabs(line, byte)


def _tabs(line: Column, byte: Column) -> Column:
    before = F.hex(F.substring(line.cast("binary"), F.lit(1), byte.cast("int")))
    return F.length(F.regexp_replace(F.regexp_replace(before, "(..)", "$1."), "(?!09\\.)..\\.|(09)\\.", "$1")) / 2


def search(lines: DataFrame, word: str, keys: list[str], line: str) -> DataFrame:
    """(keys, start_col, end_col): non-overlapping matches in any letter case, in bytes of the lower-case line with tabs expanded."""
    word = word.lower()
    if not word:
        return lines.select(*keys, F.lit(0).cast("long").alias("start_col"), F.lit(0).cast("long").alias("end_col")).limit(0)
    size = len(word.encode())
    rows = lines.select(*keys, F.lower(expand_tabs(F.col(line))).alias("_l")).where(F.col("_l").contains(word))
    parts = F.split("_l", _literal(word), -1)
    # Each match begins where the one before ended, plus what lies between.
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(p) + size)))
    return rows.select(*keys, F.explode(F.slice(ends, 2, F.size(ends) - 1)).alias("end_col")).select(*keys, (F.col("end_col") - size).alias("start_col"), "end_col")


def _literal(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def search_pair(lines: DataFrame, grid: DataFrame, word: str, keys: list[str]) -> DataFrame:
    """(keys, virtual_row, pane, start_col, end_col): matches in both texts of a pair, hidden rows left out.

    ``grid`` has (keys, virtual_row, left_line, right_line), ``lines`` (keys, side, line_no, line).
    """
    panes = F.inline(F.array(*(F.struct(F.lit(s).alias("pane"), F.col(f"{s}_line").alias("line_no")) for s in ("left", "right"))))
    shown = grid.select(*keys, "virtual_row", panes).where("line_no >= 0")
    found = search(lines.withColumnRenamed("side", "pane"), word, [*keys, "pane", "line_no"], "line")
    return shown.join(found, [*keys, "pane", "line_no"]).drop("line_no")


def _priority(action: str = "action") -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.col(action)), F.lit(0))


def line_tints(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, line, action): the colour of a line is that of its smallest node, then of the first in ``PRIORITY``."""
    best = F.min_by("action", F.struct("size", (-_priority()).alias("p")))
    return spans.groupBy(*keys, "side", "line").agg(best.alias("action"))


def change_rows(grid: DataFrame, tints: DataFrame, keys: list[str]) -> DataFrame:
    """``grid`` (keys, grid_row, left_line, right_line) with ``changed``: a filler on a side, or a tint on either."""
    sides = [tints.where(F.col("side") == s).select(*keys, F.col("line").alias(f"{s}_line"), F.lit(True).alias(f"_{s}")) for s in ("left", "right")]
    rows = grid.join(sides[0], [*keys, "left_line"], "left").join(sides[1], [*keys, "right_line"], "left")
    changed = (F.col("left_line") < 0) | (F.col("right_line") < 0) | F.coalesce("_left", F.lit(False)) | F.coalesce("_right", F.lit(False))
    return rows.select(*keys, "grid_row", "left_line", "right_line", changed.alias("changed"))


def column_layers(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, line, start_col, end_col, action): what each column shows, as runs.

    The smallest node wins, then the shorter span, then ``PRIORITY``; a column
    that is updated and lies in a move shows as ``move_update``.  Spans are cut at
    all ends in their line, so the table grows with the spans and not with their columns.
    """
    place = [*keys, "side", "line"]
    edges = spans.select(*place, F.explode(F.array("start_col", "end_col")).alias("low")).distinct()
    edges = edges.withColumn("high", F.lead("low").over(Window.partitionBy(*place).orderBy("low"))).where("high IS NOT NULL")
    held = edges.join(spans, place).where("start_col <= low AND end_col >= high")
    order = F.struct("size", (F.col("end_col") - F.col("start_col")).alias("n"), (-_priority()).alias("p"))
    cells = held.groupBy(*place, "low", "high").agg(F.min_by("action", order).alias("action"), F.bool_or(F.col("action") == "move").alias("moved"))
    cells = cells.withColumn("action", F.when((F.col("action") == "update") & F.col("moved"), "move_update").otherwise(F.col("action")))
    w = Window.partitionBy(*place).orderBy("low")
    fresh = F.when((F.lag("high").over(w) == F.col("low")) & (F.lag("action").over(w) == F.col("action")), 0).otherwise(1)
    cells = cells.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(w))
    return cells.groupBy(*place, "_run", "action").agg(F.min("low").alias("start_col"), F.max("high").alias("end_col")).select(*place, "start_col", "end_col", "action")


def actions_at(spans: DataFrame, cursors: DataFrame, keys: list[str]) -> DataFrame:
    """(cursor columns, seq): the actions whose span holds a cursor (keys, side, line, col)."""
    held = cursors.join(spans.select(*keys, "side", "line", "start_col", "end_col", "seq"), [*keys, "side", "line"])
    return held.where("start_col <= col AND col < end_col").select(*cursors.columns, "seq").distinct()


def next_span(spans: DataFrame, cursors: DataFrame, keys: list[str]) -> DataFrame:
    """(cursor columns, next_line, next_col, previous_line, previous_col): the nearest span starts behind and before a cursor, around the ends.

    Places of spans and cursors are put in order once; a place's neighbours are the last starts seen from either end.
    """
    place = [*keys, "side", "line", "col"]
    starts = spans.select(*keys, "side", "line", F.col("start_col").alias("col"), F.lit(True).alias("_start"))
    places = starts.unionByName(cursors.select(*place, F.lit(False).alias("_start"))).groupBy(*place).agg(F.bool_or("_start").alias("_start"))
    here = F.when(F.col("_start"), F.struct("line", "col"))
    rise, fall = (Window.partitionBy(*keys, "side").orderBy(*(o(c) for c in ("line", "col"))) for o in (F.asc, F.desc))
    whole = Window.partitionBy(*keys, "side")
    near = {
        "_n": F.coalesce(F.last(here, True).over(fall.rowsBetween(Window.unboundedPreceding, -1)), F.min(here).over(whole)),
        "_p": F.coalesce(F.last(here, True).over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.max(here).over(whole)),
    }
    found = places.withColumns(near).where("_n IS NOT NULL").select(*place, F.col("_n.line").alias("next_line"), F.col("_n.col").alias("next_col"), F.col("_p.line").alias("previous_line"), F.col("_p.col").alias("previous_col"))
    return cursors.join(found, place).select(*cursors.columns, "next_line", "next_col", "previous_line", "previous_col")


def move_counterparts(actions: DataFrame, lines: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, from_side, line, col, grid_row): for each move, where its other end is, seen from either side.

    ``lines`` has (keys, side, line_no, start_byte, n_bytes).
    """
    moves = actions.where("action = 'move'").select(*keys, "seq", F.inline(F.array(
        F.struct(F.lit("left").alias("from_side"), F.lit("right").alias("side"), F.col("dest_start_byte").alias("byte")),
        F.struct(F.lit("right").alias("from_side"), F.lit("left").alias("side"), F.col("node.start_byte").alias("byte")),
    )))
    found = I.inside(moves, lines.withColumn("_to", F.col("start_byte") + F.col("n_bytes") + 1), [*keys, "side"], "byte", "start_byte", "_to")
    rows = grid.select(*keys, F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_line").alias("line_no"), "grid_row") for s in ("left", "right")))))
    found = found.join(rows, [*keys, "side", "line_no"], "left")
    return found.select(*keys, "seq", "from_side", F.col("line_no").alias("line"), (F.col("byte") - F.col("start_byte")).alias("col"), "grid_row")


# -- texts ------------------------------------------------------------------------


def readable_type(kind: Column) -> Column:
    """A node type in words: its short name, or itself without an empty ending."""
    known = F.create_map(*(F.lit(x) for pair in sorted(_NAMES.items()) for x in pair))
    return F.coalesce(F.try_element_at(known, kind), F.replace(F.regexp_replace(kind, _ENDINGS, ""), F.lit("_"), F.lit(" ")))


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last of them an ellipsis if something is missing."""
    if width <= 0:
        return F.lit("")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def padded(text: Column, width: int) -> Column:
    """Blanks behind, up to a width; longer texts stay."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def centred(text: Column, width: int) -> Column:
    """Blanks on both sides, one more behind if they are odd; longer texts are cut."""
    n = F.least(F.length(text), F.lit(width))
    front = F.floor((F.lit(width) - n) / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), front), F.substring(text, 1, width), F.repeat(F.lit(" "), (F.lit(width) - n - front).cast("int")))


def position_text(line: Column, col: Column) -> Column:
    """A place, counted from 1."""
    return F.format_string("L%d:%d", line + 1, col + 1)


def preview(actions: DataFrame, keys: list[str], width: int = 60, value: int = 20) -> DataFrame:
    """(keys, seq, preview): an action in one line, with its kind, and the old and new value or the node."""
    kind, label = readable_type(F.col("node.type")), F.col("node.label")
    node = F.when(label.isNotNull(), F.concat(kind, F.lit(" '"), label, F.lit("'"))).otherwise(kind)
    values = F.concat(F.lit("'"), truncated(F.col("old_value"), value), F.lit("' → '"), truncated(F.col("new_value"), value), F.lit("'"))
    detail = F.when((F.col("action") == "update") & (F.col("old_value") != "") & (F.col("new_value") != ""), values).otherwise(node)
    return actions.select(*keys, "seq", truncated(F.concat(F.upper("action"), F.lit("  "), detail), width).alias("preview"))


def range_texts(ranges: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``ranges`` (keys, side, start_byte, end_byte) with ``range``: both ends as lines and columns, counted from 1.

    ``lines`` has (keys, side, line_no, start_byte, n_bytes); a place behind the last line is its beginning.
    """
    place = [*keys, "side"]
    last = lines.groupBy(*place).agg(F.max("line_no").alias("_last"), F.max(F.col("start_byte") + F.col("n_bytes")).alias("_end"))
    ends = ranges.select(*place, "start_byte", "end_byte").distinct()
    ends = ends.select("*", F.posexplode(F.array("start_byte", "end_byte")).alias("_k", "_b")).join(last, place)
    # A place behind the end is looked up at the last line's end; the newline belongs to its line.
    ends = ends.withColumn("_at", F.least("_b", "_end"))
    rows = lines.select(*place, "line_no", F.col("start_byte").alias("_from"), (F.col("start_byte") + F.col("n_bytes") + 1).alias("_to"))
    found = I.inside(ends, rows, place, "_at", "_from", "_to")
    text = F.when(F.col("_b") > F.col("_end"), position_text(F.col("line_no"), F.lit(0))).otherwise(position_text(F.col("line_no"), F.col("_b") - F.col("_from")))
    both = found.groupBy(*place, "start_byte", "end_byte").agg(*(F.max(F.when(F.col("_k") == k, text)).alias(f"_{k}") for k in range(2)))
    return ranges.join(both.select(*place, "start_byte", "end_byte", F.concat("_0", F.lit(" - "), "_1").alias("range")), [*place, "start_byte", "end_byte"], "left")


def details(actions: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, place, field, value): what an inspector tells about each action, in order; fields without a value are left out."""
    sides = F.inline(F.array(*(F.struct(F.lit(n).alias("what"), F.when(F.col(f"{n}.tree") == "before", "left").otherwise("right").alias("side"), F.col(f"{n}.start_byte").alias("start_byte"), F.col(f"{n}.end_byte").alias("end_byte")) for n in ("node", "dest_node"))))
    spans = actions.select(*keys, "seq", sides).where("start_byte IS NOT NULL")
    texts = range_texts(spans, lines, keys).groupBy(*keys, "seq").agg(*(F.max(F.when(F.col("what") == n, F.col("range"))).alias(f"_{n}") for n in ("node", "dest_node")))
    rows = actions.join(texts, [*keys, "seq"], "left")
    fields = (
        ("action", F.upper("action")), ("type", readable_type(F.col("node.type"))), ("label", F.col("node.label")), ("range", F.col("_node")), ("new range", F.col("_dest_node")),
        ("old value", F.col("old_value")), ("new value", F.col("new_value")), ("parent", readable_type(F.col("parent.type"))), ("old parent", readable_type(F.col("old_parent.type"))),
        ("group", F.col("group_id")), ("subtree", F.when(F.col("subtree"), "yes")),
    )
    told = F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("field"), value.cast("string").alias("value")) for k, (name, value) in enumerate(fields))))
    return rows.select(*keys, "seq", told).where("value IS NOT NULL")
