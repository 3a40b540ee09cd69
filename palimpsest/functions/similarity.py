"""Similarities of two texts as plain functions, and as Arrow kernels over two columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"[A-Za-z0-9_]")
#: Marks and white space around a comment.
_MARKS = "/#* \t\r\n"


def _codes(text: bytes) -> np.ndarray:
    """Each pair of neighbouring bytes as one number."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    return raw[:-1] << 8 | raw[1:]


def _dice(a: bytes, b: bytes) -> float:
    """Dice coefficient of the byte-bigram multisets; 0 if neither side has a bigram."""
    total = max(len(a) - 1, 0) + max(len(b) - 1, 0)
    if len(a) < 2 or len(b) < 2:
        return 0.0
    ka, na = np.unique(_codes(a), return_counts=True)
    kb, nb = np.unique(_codes(b), return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(na[i], nb[j]).sum()) / total


def bigram_similarity(a: str, b: str) -> float:
    """Byte-bigram Dice after trimming; equal texts 1, one empty side 0."""
    a, b = a.strip(), b.strip()
    if a == b:
        return 1.0
    return _dice(a.encode(), b.encode()) if a and b else 0.0


def clean_comment(text: str) -> str:
    return text.lower().strip(_MARKS)


def comment_similarity(a: str, b: str) -> float:
    """Byte-bigram Dice over the letters a-z and digits of two cleaned comments; both empty 1, one empty 0, equal 1."""
    a, b = clean_comment(a), clean_comment(b)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return _dice(*(re.sub(r"[^a-z0-9]+", "", x).encode() for x in (a, b)))


def levenshtein(a: str, b: str) -> int:
    """Edit distance in code points, one row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    y = np.array([ord(c) for c in b], np.int64)
    steps = np.arange(len(b) + 1)
    row = steps
    for i, c in enumerate(a, 1):
        here = np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))
        here = np.concatenate(([i], here))
        # Insertions run along the row: the least of what lies to the left, plus the way from there.
        row = np.minimum.accumulate(here - steps) + steps
    return int(row[-1])


def levenshtein_ratio(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - levenshtein(a, b) / longest if longest else 1.0


def has_word(text: str) -> bool:
    return _WORD.search(text) is not None


def leaf_similarity(a: Iterable[str], b: Iterable[str]) -> float:
    """Dice coefficient of two multisets of labels, of those with a word character; 0 without any."""
    from collections import Counter

    ca, cb = (Counter(x for x in labels if has_word(x)) for labels in (a, b))
    total = ca.total() + cb.total()
    return 2.0 * (ca & cb).total() / total if total else 0.0


def with_similarity(df: DataFrame, a: str, b: str, measure: Callable[[str, str], float], out: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``measure`` of columns ``a`` and ``b``, rounded to six places; null on either side gives null.  Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0), batch.column(1), strict=True)
            found = [round(measure(x.as_py(), y.as_py()), 6) if x.is_valid and y.is_valid else None for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.float64())], [*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(a, b, *keep).mapInArrow(run, f"{kinds}, `{out}` double")
