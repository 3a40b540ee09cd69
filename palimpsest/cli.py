"""The comparison as a command: two files, two folders, or a working copy.

    python -m palimpsest.cli files LEFT RIGHT [--format json|actions] [--ui | --full] [--parse-error-limit N] [--ignore-comments]
    python -m palimpsest.cli git [REVISION [REVISION]] [PATH] [--cached] [same options]

Paths of ``files`` go to Spark's reader, so they may lie in any store that it
reads.  One JSON document a pair is printed, or its mapping and actions in words.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diff as P
from .shipping import ship
from .sources import git as G


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description="Compare texts by their structure.")
    modes = out.add_subparsers(dest="mode", required=True)
    files = modes.add_parser("files", help="two files, or two folders")
    files.add_argument("left")
    files.add_argument("right")
    work = modes.add_parser("git", help="a working copy: its changes, or two revisions")
    work.add_argument("names", nargs="*", help="revisions, then a path")
    work.add_argument("--cached", action="store_true", help="staged changes only")
    work.add_argument("--folder", default=".")
    for mode in (files, work):
        mode.add_argument("-f", "--format", choices=("json", "actions"), default="json")
        mode.add_argument("-e", "--parse-error-limit", type=int, default=0)
        mode.add_argument("--ui", action="store_true", help="alignment and highlights instead of actions")
        mode.add_argument("--full", action="store_true", help="all sections")
        mode.add_argument("-C", "--ignore-comments", action="store_true")
    return out


def options(args: argparse.Namespace) -> P.Options:
    """Actions alone, unless alignment and highlights, or all, are asked for."""
    extra = args.ui or args.full
    return P.Options(parse_error_limit=args.parse_error_limit, ignore_comments=args.ignore_comments, actions=args.full or not args.ui or args.format == "actions", alignment=extra, highlights=extra)


def _pair_of_files(spark: SparkSession, left: str, right: str) -> DataFrame:
    """The pairs of two folders, or one pair of two files; what is missing raises."""
    reader = spark.read.format("binaryFile")
    files = [reader.load(path).select("path", "content") for path in (left, right)]
    if all(os.path.isfile(p) for p in (left, right)) or all(f.count() == 1 for f in files) and not any(os.path.isdir(p) for p in (left, right)):
        a, b = (f.select(F.col("content").alias(side)) for f, side in zip(files, ("src", "dst"), strict=True))
        names = (F.lit(left).alias("pair_id"), F.lit(left).alias("src_name"), F.lit(right).alias("dst_name"))
        return P.texts_of(a.limit(1).crossJoin(b.limit(1)).select(*names, "src", "dst", F.lit(False).alias("is_conflict")))  # one row with one row
    return P.pairs_of_files(spark, left, right)


def _pairs_of_git(spark: SparkSession, folder: str, names: Sequence[str], cached: bool) -> DataFrame:
    if not G.is_repository(folder):
        raise SystemExit(f"{folder} is no working copy")
    revisions = [n for n in names if G.is_revision(folder, n)][:2]
    path = next((n for n in names if n not in revisions), "")
    old, new = (*revisions, "", "")[:2]
    files = G.changed_files(spark, folder, old, new, path)
    rows = G.between_revisions(files, old, new) if old else G.sections(files)
    if cached and not old:
        rows = rows.where("section = 'staged'")
    rows = G.contents_to_compare(rows, old, new)
    return P.texts_of(G.pairs(folder, rows))


def run(spark: SparkSession, argv: Sequence[str], out: TextIO = sys.stdout) -> None:
    args = parser().parse_args(argv)
    ship(spark)
    pairs = _pair_of_files(spark, args.left, args.right) if args.mode == "files" else _pairs_of_git(spark, args.folder, args.names, args.cached)
    found = P.diff(pairs, options(args)).cache()
    if args.format == "json":
        for row in P.envelope(found).orderBy("pair_id").toLocalIterator():
            print(row.envelope, file=out)
    else:
        # One ordered table: a pair's name, its mapping, its actions.
        names = found.select("pair_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), F.col("pair_id").alias("line"))
        mapped = P.mappings(found).select("pair_id", F.lit(1).alias("part"), F.col("src_id").alias("seq"), F.format_string("  %d -> %d", "src_id", "dst_id").alias("line"))
        acted = P.printed(found).select("pair_id", F.lit(2).alias("part"), "seq", F.concat(F.lit("  "), "line").alias("line"))
        for row in names.unionByName(mapped).unionByName(acted).orderBy("pair_id", "part", "seq").toLocalIterator():
            print(row.line, file=out)
    found.unpersist()


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
