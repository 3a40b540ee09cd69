"""Lines of documents: offsets, frequencies, anchors, near copies and their overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines in at most so many documents give all pairs of them; see ``copy_groups`` for the others.
RARE_DOCUMENTS = 20


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line); a trailing newline gives a last empty line."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def line_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Start of each line in bytes."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines(docs, key, text).select(key, "line_no", start.alias("start_byte"), F.octet_length("line").cast("long").alias("n_bytes"))


def line_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return lines(docs, key, text).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))


def near_copy_pairs(docs: DataFrame, min_length: int = 0) -> DataFrame:
    """(a, b): documents, a < b, that share a line in at most ``RARE_DOCUMENTS`` documents.

    Rarity bounds the partners a line can bring, so the join cannot blow up.
    Documents that share only lines above the bound are left to ``linked_pairs``.
    Lines shorter than ``min_length`` do not count; by default all do.
    """
    return _near(_groups(docs, min_length)).distinct()


def _near(groups: DataFrame) -> DataFrame:
    rare = groups.where((F.col("kind") == "line") & (F.col("n") <= RARE_DOCUMENTS))
    return rare.select("key", F.col("doc_id").alias("a")).join(rare.select("key", F.col("doc_id").alias("b")), "key").where("a < b").select("a", "b")


def copy_groups(docs: DataFrame, min_length: int = 0) -> DataFrame:
    """(kind, key, n, representative, doc_id): documents that share a line or have equal texts.

    One group for each line (of ``min_length`` or more) and for each text that
    several documents hold, whatever their number; ``key`` is its SHA-256 and
    ``representative`` the smallest id.  Two documents share such a line exactly if
    they are in one group, so the table stands for all pairs and grows with
    the lines, not with the square of a group.
    """
    return _groups(docs, min_length).select("kind", F.lower(F.hex("key")).alias("key"), "n", "representative", "doc_id")


def _groups(docs: DataFrame, min_length: int, kinds: tuple[str, ...] = ("line", "text")) -> DataFrame:
    known = docs.where("doc_id IS NOT NULL")
    held = known.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("part")).where(F.length("part") >= min_length)
    units = {"line": held.select(F.lit("line").alias("kind"), "part", "doc_id"), "text": known.where("text != ''").select(F.lit("text").alias("kind"), F.col("text").alias("part"), "doc_id")}
    chosen = reduce(DataFrame.unionByName, (units[kind] for kind in kinds))
    # The digest and not the text goes through the exchanges.
    chosen = chosen.select("kind", F.unhex(F.sha2("part", 256)).alias("key"), "doc_id").distinct()
    groups = chosen.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("representative")).where("n > 1")
    return chosen.join(groups, ["kind", "key"])


def linked_pairs(docs: DataFrame, min_length: int = 0) -> DataFrame:
    """(a, b), a < b: the near-copy pairs, and each member of a larger group with its representative.

    Every document that shares a line (of ``min_length`` or more; by default any) or its text with another is in a pair.
    """
    # Lines apart from texts: both uses of the lines' groups then read one exchange, and lines are cut once.
    lined, same = (_groups(docs, min_length, (kind,)) for kind in ("line", "text"))
    star = lined.where(F.col("n") > RARE_DOCUMENTS).unionByName(same).where("representative < doc_id")
    return _near(lined).unionByName(star.select(F.col("representative").alias("a"), F.col("doc_id").alias("b"))).distinct()


def _paired(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that are in a pair; the others need not be cut into lines."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return docs.join(ids, "doc_id", "left_semi")


def line_dice(docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs (near copies if not given) that share a line, with the Dice coefficient of their line multisets."""
    pairs = near_copy_pairs(docs) if pairs is None else pairs
    docs = _paired(docs, pairs)
    # A line goes through the exchanges as its digest.
    freq = lines(docs).groupBy("doc_id", F.unhex(F.sha2("line", 256)).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    size = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    shared = (
        pairs.join(freq.select(F.col("doc_id").alias("a"), "line", F.col("n").alias("na")), "a")
        .join(freq.select(F.col("doc_id").alias("b"), "line", F.col("n").alias("nb")), ["b", "line"])
        .groupBy("a", "b")
        .agg(F.sum(F.least("na", "nb")).alias("shared"))
    )
    return (
        shared.join(size.select(F.col("doc_id").alias("a"), F.col("n_lines").alias("lines_a")), "a")
        .join(size.select(F.col("doc_id").alias("b"), F.col("n_lines").alias("lines_b")), "b")
        .select("a", "b", "shared", "lines_a", "lines_b", F.round(2.0 * F.col("shared") / (F.col("lines_a") + F.col("lines_b")), 6).alias("dice"))
    )


def unique_anchors(docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, a_row, b_row): lines that occur once on both sides of a pair (near copies if not given)."""
    pairs = near_copy_pairs(docs) if pairs is None else pairs
    once = lines(_paired(docs, pairs)).groupBy("doc_id", F.unhex(F.sha2("line", 256)).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("row")).where("n = 1")
    return (
        pairs.join(once.select(F.col("doc_id").alias("a"), "line", F.col("row").alias("a_row")), "a")
        .join(once.select(F.col("doc_id").alias("b"), "line", F.col("row").alias("b_row")), ["b", "line"])
        .select("a", "b", "a_row", "b_row")
    )


def common_ends(docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, prefix, suffix): equal lines at both ends of a pair (near copies if not given), which do not overlap."""
    pairs = near_copy_pairs(docs) if pairs is None else pairs
    parts = docs.select("doc_id", F.split("text", "\n", -1).alias("l"))
    pairs = pairs.join(parts.select(F.col("doc_id").alias("a"), F.col("l").alias("x")), "a")
    pairs = pairs.join(parts.select(F.col("doc_id").alias("b"), F.col("l").alias("y")), "b")

    def equal(x: str, y: str) -> str:
        return f"""aggregate(zip_with(slice({x}, 1, least(size(x), size(y))), slice({y}, 1, least(size(x), size(y))), (p, q) -> p = q),
            named_struct('n', 0L, 'on', true), (s, e) -> named_struct('n', s.n + IF(s.on AND e, 1L, 0L), 'on', s.on AND e), s -> s.n)"""

    ends = pairs.select("a", "b", F.expr(equal("x", "y")).alias("prefix"), F.expr(equal("reverse(x)", "reverse(y)")).alias("_s"), F.expr("least(size(x), size(y))").alias("_m"))
    return ends.select("a", "b", "prefix", F.least("_s", F.col("_m") - F.col("prefix")).alias("suffix"))
