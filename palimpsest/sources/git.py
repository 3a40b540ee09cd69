"""Git as a source: parsers for what it prints, and calls of the program.

The parsers are DataFrame operators over a column of lines.  Files are listed on
the driver; contents are read by the tasks, which must reach the folder (see
:mod:`.revisions` for all files of a revision as a data source).
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Revisions with a meaning of their own: the files on disk, and the index.
DISK, INDEX = "", ":"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit('"'))


def parse_status(df: DataFrame, line: str = "line", keep: Iterable[str] = ()) -> DataFrame:
    """Porcelain status lines to (path, old_path, status, staged, unstaged), beside the columns in ``keep``.

    Lines under four characters are skipped.  Where the first letter says that
    the file was renamed or copied, the old path stands before an arrow.
    """
    df = df.where(F.length(line) >= 4).select(
        *keep, F.substring(line, 1, 1).alias("_x"), F.substring(line, 2, 1).alias("_y"), _bare(F.expr(f"substring(`{line}`, 4)")).alias("_rest")
    )
    part = F.split("_rest", " -> ", -1)
    moved = F.col("_x").isin("R", "C") & (F.size(part) == 2)
    return df.select(
        *keep,
        F.when(moved, _bare(F.get(part, F.lit(1)))).otherwise(F.col("_rest")).alias("path"),
        F.when(moved, _bare(F.get(part, F.lit(0)))).alias("old_path"),
        F.concat("_x", "_y").alias("status"),
        (~F.col("_x").isin(" ", "?", "!")).alias("staged"),
        (F.col("_y") != " ").alias("unstaged"),
    )


def parse_name_status(df: DataFrame, line: str = "line", keep: Iterable[str] = ()) -> DataFrame:
    """Tab-separated changed names to (status, path, old_path), beside the columns in ``keep``; R rows hold old and new."""
    df = df.select(*keep, F.transform(F.split(F.btrim(F.col(line), F.lit(" \t\r\n")), "\t", -1), _bare).alias("_p"))
    first, second, third = (F.get("_p", F.lit(k)) for k in range(3))
    renamed = first.startswith("R") & (F.size("_p") >= 3)
    return df.where(F.size("_p") >= 2).select(
        *keep, first.alias("status"), F.when(renamed, third).otherwise(second).alias("path"), F.when(renamed, second).alias("old_path")
    )


def _unmerged() -> Column:
    return F.col("status").contains("U") | F.col("status").isin("AA", "DD")


def sections(files: DataFrame, staged_only: bool = False) -> DataFrame:
    """The rows of a file list, with ``section`` and the ``shown`` status.

    A file with changes in the index and on disk stands in both sections, each
    with its own letter; staged ones come first (``place``).
    """
    own = F.when(F.col("status") == "??", "??").otherwise(F.concat(F.lit(" "), F.substring("status", 2, 1)))
    staged = F.struct(F.lit(0).alias("place"), F.lit("staged").alias("section"), F.concat(F.substring("status", 1, 1), F.lit(" ")).alias("shown"))
    unstaged = F.struct(F.lit(1).alias("place"), F.lit("unstaged").alias("section"), own.alias("shown"))
    rows = [F.when(F.col("staged"), staged)] + ([] if staged_only else [F.when(F.col("unstaged"), unstaged)])
    return files.select("*", F.inline(F.array_compact(F.array(*rows))))


def between_revisions(files: DataFrame, old: str, new: str = DISK) -> DataFrame:
    """The one section of a comparison of revisions; a status of one letter is filled up."""
    shown = F.when(F.length("status") == 1, F.concat("status", F.lit(" "))).otherwise(F.col("status"))
    title = f"Changes: {old} \u2192 {new or 'Working Copy'}"
    return files.select("*", F.lit(0).alias("place"), F.lit(title).alias("section"), shown.alias("shown"))


def contents_to_compare(files: DataFrame, old: str = "", new: str = DISK) -> DataFrame:
    """For each row of a file list what to read: (left_revision, left_path, right_revision, right_path).

    Unmerged files compare the last commit with the disk, then come the two
    revisions if there are any, then staged files (last commit and index), then
    the others (index and disk; ``pairs`` takes the commit where the index has nothing).
    """
    staged = F.col("section") == "staged"
    left = F.when(_unmerged(), "HEAD").when(F.lit(bool(old)), old).when(staged, "HEAD").otherwise(INDEX)
    right = F.when(_unmerged(), DISK).when(F.lit(bool(old)), new).when(staged, INDEX).otherwise(DISK)
    return files.select(
        "*", _unmerged().alias("conflict"), left.alias("left_revision"), F.coalesce("old_path", "path").alias("left_path"), right.alias("right_revision"), F.col("path").alias("right_path")
    )


def stageable(files: DataFrame, markers: Column) -> Column:
    """Whether a row of :func:`sections` may be staged: it is not yet, is not unmerged, and ``markers`` (conflict markers in its text) is false."""
    return (F.col("section") == "unstaged") & ~_unmerged() & ~F.coalesce(markers, F.lit(False))


def committable(files: DataFrame) -> DataFrame:
    """One row: whether anything is staged."""
    return files.agg(F.coalesce(F.bool_or(F.col("section") == "staged"), F.lit(False)).alias("committable"))


# -- the program --------------------------------------------------------------


def run_git(folder: str, *args: str) -> bytes:
    """What git prints; a failure raises with what it said."""
    done = subprocess.run(["git", *args], cwd=folder or None, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0] if args else ''}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def is_repository(folder: str) -> bool:
    try:
        return run_git(folder, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (RuntimeError, OSError):
        return False


def is_revision(folder: str, revision: str) -> bool:
    try:
        run_git(folder, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}")
    except (RuntimeError, OSError):
        return False
    return True


def _lines(spark: SparkSession, raw: bytes) -> DataFrame:
    return spark.createDataFrame([(x,) for x in raw.decode(errors="replace").split("\n")], "line string")


def status(spark: SparkSession, folder: str, path: str = "") -> DataFrame:
    return parse_status(_lines(spark, run_git(folder, "status", "--porcelain=v1", *(["--", path] if path else []))))


def changed_files(spark: SparkSession, folder: str, old: str = "", new: str = "", path: str = "") -> DataFrame:
    """Files changed between two revisions, or against the disk, or by status, as far as they are named."""
    if not old:
        return status(spark, folder, path)
    found = parse_name_status(_lines(spark, run_git(folder, "diff", "--name-status", "-M", *filter(None, (old, new)), *(["--", path] if path else []))))
    return found.select("path", "old_path", "status", F.lit(False).alias("staged"), F.lit(False).alias("unstaged"))


def content(folder: str, path: str, revision: str) -> bytes | None:
    """A file at a revision, on disk (``DISK``) or in the index (``INDEX``); none where it is missing."""
    try:
        if revision == DISK:
            with open(os.path.join(folder, path), "rb") as f:
                return f.read()
        return run_git(folder, "show", f":{path}" if revision == INDEX else f"{revision}:{path}")
    except (RuntimeError, OSError):
        return None


PAIRS = "pair_id string, src_name string, dst_name string, src binary, dst binary, is_conflict boolean"


def pairs(folder: str, files: DataFrame) -> DataFrame:
    """(pair_id, src_name, dst_name, src, dst, is_conflict) of rows of :func:`contents_to_compare`; the tasks read the contents."""
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = content(folder, r["left_path"], r["left_revision"])
                if left is None and r["left_revision"] == INDEX:
                    left = content(folder, r["left_path"], "HEAD")
                right = content(folder, r["right_path"], r["right_revision"])
                row = (f"{r['section']}:{r['path']}", r["left_path"], r["path"], left or b"", right or b"", r["conflict"])
                kinds = (*[pa.string()] * 3, *[pa.binary()] * 2, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    rows = files.select("section", "path", "left_path", "left_revision", "right_path", "right_revision", "conflict")
    parts = 2 * files.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts, "section", "path").mapInArrow(run, PAIRS)
