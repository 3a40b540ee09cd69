"""Packing by power-of-two decomposition.

A document of L tokens (its ids and a closing id) is cut into as many pieces
of ``max_len`` as fit and one piece for each set bit of the rest, the longest
first.  Every piece is a sequence of its own, so no sequence crosses a
document and none needs padding; sequences of equal length form a bucket,
named by ``bucket`` (log2 of the length) and written apart by
:func:`write_buckets`.

``sequence_id`` holds the bucket in its top bits, then the task and a counter,
so the ids of a bucket form one range and no shuffle, sort or global count is
needed.  Ids are unique in every run; they follow the layout of the input, so
another layout of the same rows gives others.  A task that is run again puts
its rows in place of the lost ones.

Cases: null or empty text still has the closing id, one piece of length 1;
repeated rows are packed each for itself and ties need no rule; a very long text
is encoded as a whole and its pieces come in batches; further columns are not
read, so clashing names do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import loaded
from .common import gathered
from .tokens import SLICE_CHARS, slices


def cut(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, piece length) of all pieces: powers of two, the longest first in each document."""
    lengths = np.asarray(lengths, np.int64)
    bits = np.arange(max_len.bit_length() - 2, -1, -1)
    whole = lengths // max_len
    rest = (lengths[:, None] >> bits & 1).astype(bool)
    document = np.concatenate((np.repeat(np.arange(len(lengths)), whole), np.nonzero(rest)[0]))
    length = np.concatenate((np.full(whole.sum(), max_len), np.broadcast_to(1 << bits, rest.shape)[rest]))
    order = np.argsort(document, kind="stable")
    return document[order], length[order]


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    max_len: int = 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row for each piece, with its ids where ``with_ids`` holds.

    Texts are encoded together up to ``slice_chars`` characters: more take less
    time, and about 30 bytes of a worker's memory each.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        count = 0
        with loaded(vocabulary) as bpe:
            for batch in gathered(batches, size=slice_chars):
                for first, part in slices(batch.column(1), slice_chars):
                    ids, rows = bpe.encode_batch(part).tokens()
                    ids = np.insert(ids, rows[1:], end_id)
                    rows = rows + np.arange(len(rows))
                    document, length = cut(np.diff(rows), max_len)
                    ends = np.cumsum(length)
                    begins = ends - length
                    data = memoryview(ids).cast("B")
                    sums = [crc32(data[a:b]) for a, b in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)]
                    bucket = np.frexp(length)[1] - 1
                    sequence = bucket.astype(np.int64) << 58 | task << 34 | np.arange(count, count + len(length))
                    count += len(length)
                    numbers = (begins - rows[document], length, sums, np.diff(rows)[document], sequence, np.zeros(len(length)))
                    columns = [batch.column(0).take(pa.array(first + document)), *(pa.array(c, pa.int64()) for c in numbers), pa.array(bucket, pa.int32())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(ids.view("<i4"))))
                    # Many ids at once would fill the buffers of the executor.
                    table = pa.RecordBatch.from_arrays(columns, [*names, "ids"] if with_ids else names)
                    for k in range(0, len(length), 10_000):
                        yield table.slice(k, 10_000)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    return df.select(key, text).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder for each bucket, so that a batch of equal sequences is a plain read."""
    pieces.write.partitionBy("bucket").parquet(path)
