"""Helpers shared by the operators: shared-folder tables and input reading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, and tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; only Spark's reader ever opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent on one machine, as in tests, a temporary
    folder is made once for the session; on a cluster that would be a folder of
    the driver alone, and is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    This cuts the lineage: an executor lost later costs a re-read, not a
    recomputation, and several consumers share one computation.
    """
    return _write(df, label, compression)[0]


def _write(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Tables of one step, dropped together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """:func:`materialize`, after which the shuffle files of ``df`` may go."""
        out, path = _write(df, label)
        self.paths.append(path)
        collect_garbage(self.spark)
        return out

    def drop(self) -> None:
        """Delete the tables; queries that still read them fail."""
        jvm = self.spark.sparkContext._jvm
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths.clear()


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str | F.Column, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def released(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` kernel that gives its memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def gathered(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts hold ``size`` bytes, for kernels that do better on many texts at once."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.column(column).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def parts(texts: pa.Array, rows: int = 256, chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in turn, null as empty, in lists of bounded size, or one long text."""
    held, total = [], 0
    for value in texts:
        text = value.as_py() or ""
        if held and (len(held) == rows or total + len(text) > chars):
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def hint(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few; narrow rows only."""
    return F.broadcast(df) if rows <= limit else df


def release() -> None:
    """Give memory that a Python worker no longer uses back, as Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it
