"""Registered queries of what a viewer shows, and of rules; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import nodes as N
from ..operators import viewer as V
from ..sources import parsing as T
from ..sources import rules as R
from .joins import _word_nodes
from .queries import _code_side, _docs, _marks
from .join_oracles import _WORDS
from .oracles import _LINES
from .oracles import ORACLE_SQL as FIRST


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(_docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of each document beside its even lines."""
    n = F.col("line_no")
    return _lines(spark, sf_dir).select("doc_id", n.alias("grid_row"), n.alias("left_line"), F.when(n % 2 == 0, n).otherwise(-1).alias("right_line"))


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor in column 5 of every line."""
    return _lines(spark, sf_dir).select("doc_id", F.lit("left").alias("side"), F.col("line_no").alias("line"), F.lit(5).cast("long").alias("col"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).withColumn("line", F.col("line").cast("long"))


def marks_at_cursor(spark, sf_dir):
    """How many actions show at a cursor in column 5 of each line."""
    found = V.actions_at(_spans(spark, sf_dir), _cursors(spark, sf_dir), ["doc_id"])
    return found.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


def next_mark(spark, sf_dir):
    """The highlights before and behind a cursor in column 5 of each line, around the ends of the document."""
    return V.next_span(_spans(spark, sf_dir), _cursors(spark, sf_dir), ["doc_id"]).select("doc_id", "line", "next_line", "next_col", "previous_line", "previous_col")


def search_both(spark, sf_dir):
    """Matches of a word in both texts of a grid."""
    lines = _lines(spark, sf_dir)
    both = lines.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return V.search_pair(both, _half(spark, sf_dir).withColumnRenamed("grid_row", "virtual_row"), "Tion", ["doc_id"])


def changed_rows(spark, sf_dir):
    """Rows of a grid that changed: fillers, and lines with a tint."""
    tints = V.line_tints(_spans(spark, sf_dir), ["doc_id"])
    return V.change_rows(_half(spark, sf_dir), tints, ["doc_id"])


def move_ends(spark, sf_dir):
    """Both ends of moves of every odd line to the middle of the line before it."""
    lines = L.line_offsets(_docs(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))
    sides = lines.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    before = lines.select("doc_id", (F.col("line_no") + 1).alias("line_no"), (F.col("start_byte") + F.expr("n_bytes div 2")).alias("dest_start_byte"))
    moves = lines.where("line_no % 2 = 1").join(before, ["doc_id", "line_no"]).select("doc_id", F.col("line_no").alias("seq"), F.lit("move").alias("action"), F.struct("start_byte").alias("node"), "dest_start_byte")
    grid = lines.select("doc_id", F.col("line_no").alias("grid_row"), F.col("line_no").alias("left_line"), F.col("line_no").alias("right_line"))
    return V.move_counterparts(moves, sides, grid, ["doc_id"])


def planted_keywords(spark, sf_dir):
    """Blocks and lines whose words all end in a vowel or a point."""
    nodes = _word_nodes(spark, sf_dir).withColumn("is_keyword", F.col("label").rlike("[aeiou.]$"))
    return N.keyword_trees(nodes)


def code_rule_keywords(spark, sf_dir):
    """Keywords in the first versions of programs, by a join with the table of rules."""
    leaves = T.nodes(_code_side(spark, sf_dir, "src"), columns=("key", "pre_size", "label", "lang")).where("pre_size = 1")
    rules = R.rule_table(spark).where("kind = 'keywords'").select("lang", F.col("key").alias("label"))
    return leaves.join(F.broadcast(rules), ["lang", "label"]).groupBy(F.col("key").alias("pair_id"), F.col("label").alias("word")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (marks_at_cursor, next_mark, search_both, changed_rows, move_ends, planted_keywords, code_rule_keywords)}

#: Highlights of words and lines, as in ``column_layers``.
_MARKS = FIRST["column_layers"].partition("cells AS")[0].rstrip().rstrip(",")

ORACLE_SQL = {
    "marks_at_cursor": f"""{_MARKS} SELECT doc_id, line_no AS line, count(*) AS n FROM (SELECT DISTINCT doc_id, line_no, a, action FROM spans WHERE a <= 5 AND 5 < b) GROUP BY doc_id, line_no""",
    "next_mark": f"""{_MARKS}, starts AS (SELECT DISTINCT doc_id, line_no, a, line_no * 1000000 + a AS at FROM spans), cursors AS (SELECT doc_id, line_no, line_no * 1000000 + 5 AS at FROM lines),
        near AS (SELECT c.doc_id, c.line_no AS line, coalesce(min(s.at) FILTER (s.at > c.at), min(s.at)) AS n, coalesce(max(s.at) FILTER (s.at < c.at), max(s.at)) AS p FROM cursors c JOIN starts s ON s.doc_id = c.doc_id GROUP BY ALL)
        SELECT doc_id, line, n // 1000000 AS next_line, n % 1000000 AS next_col, p // 1000000 AS previous_line, p % 1000000 AS previous_col FROM near""",
    "search_both": f"""WITH m AS ({FIRST["search_matches"]}) SELECT doc_id, line_no AS virtual_row, 'left' AS pane, start_col, end_col FROM m UNION ALL SELECT doc_id, line_no, 'right', start_col, end_col FROM m WHERE line_no % 2 = 0""",
    "changed_rows": f"""WITH {_LINES} SELECT doc_id, line_no AS grid_row, line_no AS left_line, CASE WHEN line_no % 2 = 0 THEN line_no ELSE -1 END AS right_line,
        line_no % 2 = 1 OR contains(lower(line), 'the') OR contains(lower(line), 'tion') OR doc_id % 3 = 0 AND line != '' AS changed FROM lines""",
    "move_ends": f"""WITH o AS ({FIRST["line_offsets"]}) SELECT x.doc_id, x.line_no AS seq, side AS from_side, CASE side WHEN 'left' THEN y.line_no ELSE x.line_no END AS line,
            CASE side WHEN 'left' THEN y.n_bytes // 2 ELSE 0 END AS col, CASE side WHEN 'left' THEN y.line_no ELSE x.line_no END AS grid_row
        FROM o x JOIN o y ON y.doc_id = x.doc_id AND y.line_no = x.line_no - 1, (VALUES ('left'), ('right')) t(side) WHERE x.line_no % 2 = 1""",
    "planted_keywords": f"""WITH {_WORDS}, leaves AS (SELECT key, b, r, c, regexp_matches(label, '[aeiou.]$') AS good FROM sized WHERE size = 1),
        spoken AS (SELECT key, -1 AS b, -1 AS r, bool_and(good) AS good FROM leaves GROUP BY key UNION ALL SELECT key, b, -1, bool_and(good) FROM leaves GROUP BY key, b UNION ALL SELECT key, b, r, bool_and(good) FROM leaves WHERE c >= 0 GROUP BY key, b, r)
        SELECT s.key, s.id::INT AS node_id FROM sized s JOIN spoken e ON e.key = s.key AND e.b = s.b AND e.r = s.r WHERE s.c < 0 AND s.size > 1 AND e.good""",
    "code_rule_keywords": FIRST["code_keywords"],
}
