"""A data source of files as they are at a revision: ``spark.read.format("git_revision")``.

Options: ``folder`` (a working copy that all tasks can reach), ``revision`` (by default HEAD; ``:`` is
the index, and an empty one the files on disk), ``path`` (below which files are read) and ``files`` (how
many make one partition).  Planning lists names and sizes alone; contents are read where
the partitions run, a range of files with one call of git.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .git import DISK, INDEX, run_git

SCHEMA = "path string, blob string, size long, content binary"
FILES = 500
BYTES = 32_000_000


class Files(InputPartition):
    """A range of files (path, blob, size)."""

    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


def listed(folder: str, revision: str, path: str = "") -> list[tuple[str, str, int]]:
    """(path, blob, size) of the files of a revision, without their contents; on disk blobs are empty and missing files have size -1."""
    below = ["--", path] if path else []
    if revision == DISK:
        names = run_git(folder, "ls-files", "-z", "--cached", "--others", "--exclude-standard", *below).decode(errors="surrogateescape").split("\0")
        where = {n: os.path.join(folder, n) for n in sorted(set(filter(None, names)))}
        return [(n, "", os.path.getsize(f) if os.path.isfile(f) else -1) for n, f in where.items()]
    if revision == INDEX:
        # Files in conflict have several stages; the first listed is taken.
        rows = [x.split("\t", 1) for x in run_git(folder, "ls-files", "-s", "-z", *below).decode(errors="surrogateescape").split("\0") if x]
        blobs: dict[str, str] = {}
        for head, name in rows:
            if not head.startswith("160000"):
                blobs.setdefault(name, head.split()[1])
        return [(n, b, 0) for n, b in sorted(blobs.items())]
    rows = [x.split("\t", 1) for x in run_git(folder, "ls-tree", "-r", "-l", "-z", revision, *below).decode(errors="surrogateescape").split("\0") if x]
    return sorted((name, head.split()[2], int(head.split()[3])) for head, name in rows if head.split()[1] == "blob")


def ranges(files: list[tuple[str, str, int]], count: int = FILES, size: int = BYTES) -> Iterator[list[tuple[str, str, int]]]:
    """Consecutive files, at most ``count`` of them and about ``size`` bytes together."""
    held, total = [], 0
    for f in files:
        if held and (len(held) >= count or total + max(f[2], 0) > size):
            yield held
            held, total = [], 0
        held.append(f)
        total += max(f[2], 0)
    if held:
        yield held


def contents(folder: str, files: list[tuple[str, str, int]]) -> Iterator[tuple[str, str, int, bytes | None]]:
    """Files with their contents, null where a file is gone; blobs come from one process."""
    batch = subprocess.Popen(["git", "cat-file", "--batch"], cwd=folder, stdin=subprocess.PIPE, stdout=subprocess.PIPE) if any(b for _, b, _ in files) else None
    try:
        for name, blob, _ in files:
            data = None
            if not blob:
                where = os.path.join(folder, name)
                if os.path.isfile(where):
                    with open(where, "rb") as f:
                        data = f.read()
            else:
                batch.stdin.write(blob.encode() + b"\n")
                batch.stdin.flush()
                head = batch.stdout.readline().split()
                if len(head) == 3:
                    data = batch.stdout.read(int(head[2]))
                    batch.stdout.read(1)
            yield name, blob, -1 if data is None else len(data), data
    finally:
        if batch is not None:
            batch.stdin.close()
            batch.stdout.close()
            batch.wait()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.revision = options["folder"], options.get("revision", "HEAD")
        self.path, self.count = options.get("path", ""), int(options.get("files", FILES))

    def partitions(self) -> list[InputPartition]:
        return [Files(part) for part in ranges(listed(self.folder, self.revision, self.path), self.count)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        for row in contents(self.folder, partition.files):
            shown = (os.fsencode(row[0]).decode(errors="replace"), *row[1:])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shown, kinds, strict=True)], ["path", "blob", "size", "content"])


class GitRevision(DataSource):
    """Files (path, blob, size, content) of a working copy at a revision."""

    @classmethod
    def name(cls) -> str:
        return "git_revision"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitRevision)
