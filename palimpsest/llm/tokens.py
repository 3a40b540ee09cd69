"""DataFrame forms of BPE encoding: ids, decoded text and their digests.

Cases: null text is empty text, which has no ids and decodes to the empty
string; rows are independent, so repeats and ties need no rule; a very long
text is a slice of its own and is held as a whole, with its ids; only the key
and the text are read, so further columns neither clash nor come back; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import loaded
from .common import gathered

#: Characters that a slice of a batch may hold; bounds the arrays in memory.
SLICE_CHARS = 8_000_000


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most ``limit`` characters, or one long text; null is empty."""
    start, held, total = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        if held and total + len(text) > limit:
            yield start, held
            start, held, total = k, [], 0
        held.append(text)
        total += len(text)
    if held:
        yield start, held


def encode_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array, decoded) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(vocabulary) as bpe:
            for batch in gathered(batches):
                for start, part in slices(batch.column(1)):
                    encoded = bpe.encode_batch(part)
                    ids, rows = encoded.tokens()
                    lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.view("<i4")))
                    decoded = bpe.decode_batch(encoded).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists, decoded], [key, "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row, without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(vocabulary) as bpe:
            for batch in gathered(batches):
                for start, part in slices(batch.column(1)):
                    encoded = bpe.encode_batch(part)
                    ids, rows = encoded.tokens()
                    texts = bpe.decode_batch(encoded)
                    columns = [
                        batch.column(0).slice(start, len(part)),
                        pa.array(rows[1:] - rows[:-1], pa.int64()),
                        pa.array(_digests(memoryview(ids).cast("B"), rows * 4), pa.string()),
                        pa.array(_digests(memoryview(texts.buffers()[2] or b""), pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, texts.buffers()[1]]).to_numpy()), pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(data: memoryview, edges) -> list[str]:
    edges = edges.tolist()
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
