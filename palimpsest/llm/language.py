"""Language identification by compression.

For each language a raw-content zstandard dictionary is taken from training
texts.  A text is lower-cased and cut into blocks, each block is compressed with every
dictionary, and the language with the smallest total wins.  The score falls
with the margin to the second; below ``min_margin`` the row is marked as not
accepted.

Cases: null text, or text without a letter (numbers such as a half are none), is
``und`` with score 0 and not accepted; equal sizes go to the language that sorts
first; rows are judged each for itself, so repeats get equal answers; an id that
repeats within a language teaches by its smallest part; a very long text is compressed
block by block; a table without training texts gives ``und`` for every row; only the id
and the text are read, so further columns of any name do no harm; an empty table gives no rows.
The languages themselves are a bounded set: the ``LANGUAGES`` with the most texts are learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released

#: Bounds of the training sample for each language.
TRAINING_DOCUMENTS = 200
LANGUAGES = 200
DICTIONARY_BYTES = 48_000
#: Slices of a text that is longer than its share.
SLICES = 4
#: Bytes compressed at once; short, so that the dictionary and not the text's own past decides.
BLOCK = 4_096
LEVEL = 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content for each language, from at most ``TRAINING_DOCUMENTS`` of its texts.

    The sample is the smallest hashes of the ids, so it does not follow file
    order; the ids are picked first and only their texts are read.  The texts
    of a language share its dictionary: short ones are taken whole, and what
    they leave goes to the longer ones, which give slices from all over.
    """
    rank = Window.partitionBy(lang).orderBy(F.xxhash64(F.lit("language"), key), key)
    size = F.octet_length(text).cast("long").alias("_size")
    named = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = named.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES).select(lang)
    ids = named.join(F.broadcast(known), lang, "left_semi").select(key, lang, size).withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= TRAINING_DOCUMENTS)
    sizes: dict[str, list[int]] = {}
    for row in ids.select(lang, "_size").collect():  # TRAINING_DOCUMENTS numbers for each language
        sizes.setdefault(row[0], []).append(row["_size"])
    levels = [(name, share(n, DICTIONARY_BYTES - (SLICES + 1) * len(n))) for name, n in sizes.items()]
    levels = labelled.sparkSession.createDataFrame(levels, "_lang string, _level long")
    chosen = labelled.join(F.broadcast(ids.select(key, lang).distinct()), [key, lang], "left_semi").join(F.broadcast(levels), F.col(lang) == F.col("_lang"))
    rows = chosen.select(lang, key, _slices(F.col(text), F.col("_level")).alias("part")).groupBy(lang, key).agg(F.min("part").alias("part")).collect()
    parts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        parts.setdefault(row[0], []).append((row["part"] or "").lower().encode("utf-8"))
    # The end of a dictionary is the cheapest to refer to.
    return {k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in sorted(parts.items()) if any(v)}


def share(sizes: list[int], total: int) -> int:
    """The greatest length at which texts cut to it fill ``total`` at most."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def _slices(text: F.Column, level: F.Column) -> F.Column:
    """The text, or ``SLICES`` equal slices from its beginning to its end that hold ``level`` bytes or about as many."""
    n = F.length(text)
    each = F.floor(level * n / F.octet_length(text) / SLICES).cast("int")
    parts = [F.substr(text, (F.floor((n - each) * k / (SLICES - 1)) + 1).cast("int"), each) for k in range(SLICES)]
    return F.when(F.octet_length(text) <= level, text).otherwise(F.concat_ws("\n", *parts))


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    """Cut at white space where a block has any, else anywhere."""
    out, at = [], 0
    while at < len(raw):
        end = at + size
        if end < len(raw) and (gap := raw.rfind(b" ", at + 1, end)) > 0:
            end = gap
        out.append(raw[at:end])
        at = end
    return out


class Classifier:
    """Compressors for all languages; built once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.coders = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        parts = blocks(text.lower().encode("utf-8", "surrogatepass"))
        return [sum(len(code(p)) for p in parts) for code in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is relative to the second-smallest size."""
        if not text or not self.coders or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        margin = 1.0 if len(order) == 1 else (sizes[order[1]] - best) / sizes[order[1]]
        return self.names[order[0]], 1 - 0.5 * math.exp(-30 * margin), margin


def identify(
    df: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", min_margin: float = 0.01
) -> DataFrame:
    """(key, lang_pred, score, margin, accepted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            rows = [model.classify(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cols[0], pa.string()),
                    pa.array(cols[1], pa.float64()),
                    pa.array(cols[2], pa.float64()),
                    pa.array([m >= min_margin for m in cols[2]], pa.bool_()),
                ],
                [key, "lang_pred", "score", "margin", "accepted"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, lang_pred string, score double, margin double, accepted boolean")
