"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The filter keeps, for an n-gram seen c times, the entries (n-gram, 1) to
(n-gram, 1 + floor(log2 c)).  Its level is probed from 1 on until an entry is
missing, so the count comes back as a power of two; an error can only raise a level, by
j with probability ``2 ** (-hashes * j)``.  Probabilities are smoothed order by order:
P(w | v) = (C(v w) + k P(w)) / (C(v) + k), from P(w) = (C(w) + 0.1) / (N + 0.1 (V + 1)).

The filter is made of segments by the hash of the n-gram, each as large as its
own entries need, and built by the tasks that hold them.  A filter within
``broadcast_bytes`` is broadcast; beyond, n-grams are sent to their segments
and the levels back to their documents, with the same scores.

Next to it stands an exact unigram score.  The counts of tokens that are at
least as frequent as a threshold, found so that at most ``broadcast_tokens`` are,
are broadcast; the other tokens of a document are joined with the rest of the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

#: A-Z in small letters; bytes.split() then cuts at the six ASCII blanks.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The token behind the last word; no word is empty.
END = b""


@dataclass(frozen=True)
class Model:
    """Parameters of the model."""

    order: int = 2
    #: Weight of the lower order, in occurrences.
    prior: float = 20.0
    #: Added to the count of each token.
    added: float = 0.1
    hashes: int = 6
    bits: int = 9
    #: Tokens that a task counts, and scores, at once.
    batch_tokens: int = 500_000
    score_tokens: int = 400_000
    #: Tokens of the training texts for each segment of the filter.
    segment_tokens: int = 32_768
    #: Training tokens whose n-grams one task adds up for the filter at once.
    group_tokens: int = 1_000_000
    broadcast_bytes: int = 128_000_000
    #: Bytes of the filter that answer one group of batches.
    shard_bytes: int = 32_000_000
    broadcast_tokens: int = 262_144
    #: Where the filter is not broadcast: characters whose n-grams are asked for at once.
    batch_chars: int = 8_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    words = (text or "").encode().translate(_LOWER).split()
    words.append(END)
    return words


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer; both constants are those of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_START = np.uint64(xxhash.xxh64_intdigest(b"start of a text", 1))


class _Numbers(dict):
    """Numbers tokens as they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


class Batch:
    """Tokens of some texts as numbers, with the hashes of their n-grams."""

    def __init__(self, texts: Iterable[str | None] = ()):
        self._numbers, self._parts, self.size = _Numbers(), [], 0
        for text in texts:
            self.add(text)

    def add(self, text: str | None) -> None:
        words = tokens(text)
        self._parts.append(np.fromiter(map(self._numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> Batch:
        """No more texts; their words, places and lengths are known from here on."""
        self.words = list(self._numbers)
        self.lengths = np.array([len(p) for p in self._parts], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([np.zeros(0, np.int32), *self._parts])
        self._numbers, self._parts = _Numbers(), []
        return self

    def grams(self, order: int) -> list[np.ndarray]:
        """Hashes of the n-grams that end at each token, for 1 to ``order``; a text begins with a start, and 0 stands where an n-gram would begin before it."""
        own = np.array([xxhash.xxh64_intdigest(w, 1) for w in self.words], np.uint64)[self.ids]
        out = [own]
        for n in range(2, order + 1):
            context = self.contexts(out[-1], n)
            out.append(np.where(context == 0, np.uint64(0), _mix(context * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(n))))
        return out

    def contexts(self, shorter: np.ndarray, n: int) -> np.ndarray:
        """For each token the (n - 1)-gram before it."""
        out = np.empty_like(shorter)
        out[1:] = shorter[:-1]
        out[self.first] = _START if n == 2 else 0
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text; every text has one at least."""
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, Batch]]:
    """Rows gathered until their texts hold ``size`` tokens; a long text is not cut."""
    rows: list[pa.RecordBatch] = []
    held = Batch()
    for batch in batches:
        begin = 0
        for k, text in enumerate(batch.column("text")):
            held.add(text.as_py())
            if held.size >= size:
                yield pa.Table.from_batches([*rows, batch.slice(begin, k + 1 - begin)]), held.close()
                rows, held, begin = [], Batch(), k + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if rows:
        yield pa.Table.from_batches(rows), held.close()


def vocabulary(docs: DataFrame, held: int = 300_000) -> DataFrame:
    """(token, n): exact counts; the end is the empty token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["token", "n"])
            n.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                n.update(tokens(text.as_py()))
                if len(n) > held:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(released(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


# The filter.


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), exact up to 2^53."""
    return np.frexp(counts.astype(np.float64))[1]


#: The count that stands for a level: the geometric mean of the least and greatest count of the level; 0 for none.
VALUES = np.array([0.0, *(((1 << k - 1) * ((1 << k) - 1)) ** 0.5 for k in range(1, 64))])


def _places(grams: np.ndarray, level: int, bits: np.ndarray, k: int) -> np.ndarray:
    """Bit of the k-th hash of (n-gram, level) in segments of so many bits (below 2^32)."""
    h = _mix(grams + np.uint64((level * 64 + k) * 0xD6E8FEB86659FD93 % (1 << 64)))
    return ((h >> np.uint64(32)) * bits) >> np.uint64(32)


def segment_filter(grams: np.ndarray, counts: np.ndarray, hashes: int, bits: int) -> bytes:
    """The bits of one segment; an empty one has none."""
    levels = level_of(counts)
    if not len(grams):
        return b""
    size = np.uint64(-(-int(levels.sum()) * bits // 8) * 8)
    if size >= 1 << 32:
        raise ValueError("a segment is too large: use more of them")
    out = np.zeros(int(size), bool)
    for level in range(1, int(levels.max()) + 1):
        own = grams[levels >= level]
        for k in range(hashes):
            out[_places(own, level, size, k)] = True
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class Filter:
    """Some segments of a filter, side by side; other segments have no bytes here."""

    data: np.ndarray
    start: np.ndarray
    hashes: int

    @classmethod
    def of(cls, segments: int, numbers: list[int], parts: list[bytes], hashes: int) -> Filter:
        size = np.zeros(segments + 1, np.int64)
        size[np.array(numbers, np.int64) + 1] = list(map(len, parts))
        order = sorted(range(len(parts)), key=numbers.__getitem__)
        return cls(np.frombuffer(b"".join(parts[k] for k in order), np.uint8), np.cumsum(size), hashes)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels of n-grams; sorted ones keep the probes close together."""
        out = np.zeros(len(grams), np.uint8)
        segment = _segment(grams, len(self.start) - 1)
        start, bits = self.start[segment], (8 * (self.start[segment + 1] - self.start[segment])).astype(np.uint64)
        active = np.nonzero(bits)[0]
        level = 0
        while len(active):
            level += 1
            for k in range(self.hashes):
                bit = _places(grams[active], level, bits[active], k)
                hit = self.data[start[active] + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                active = active[hit.astype(bool)]
            out[active] = level
        return out


def _segment(grams: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each n-gram, in order of the hashes; ``segments`` is a power of two above 1."""
    return (grams >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def _power(x: float) -> int:
    """The next power of two."""
    return 1 << ceil(log2(x))


def _cut(grams: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted n-grams by segment."""
    own = _segment(grams, segments)
    at = np.concatenate(([0], np.nonzero(np.diff(own))[0] + 1, [len(own)])) if len(own) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(own[a]), slice(a, b)


def build_filter(docs: DataFrame, segments: int, model: Model = Model()) -> DataFrame:
    """(segment, grams, filter): one row for each segment that has n-grams of ``docs`` (text).

    Tasks add up the n-grams of their texts before they send them, in groups of neighbouring segments; every
    segment is then built by one task.
    """
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(segments, _power(max(256, segments * model.segment_tokens / model.group_tokens)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(batches, model.batch_tokens):
            starts = np.full(len(batch.first), _START)
            found = np.concatenate([*batch.grams(model.order), starts])
            grams, counts = np.unique(found[found != 0], return_counts=True)
            rows = [(s, grams[at].tobytes(), counts[at].astype(np.int32).tobytes()) for s, at in _cut(grams, groups)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "grams", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None:
                each, at = np.unique(np.concatenate(grams), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(each))
                made = [(s, len(each[k]), segment_filter(each[k], n[k], model.hashes, model.bits)) for s, k in _cut(each, segments)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["segment", "grams", "filter"])

        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                if part != own:
                    yield from done()
                    own, grams, counts = part, [], []
                grams.append(np.frombuffer(batch.column("grams")[k].as_py(), np.uint64))
                counts.append(np.frombuffer(batch.column("counts")[k].as_py(), np.int32))
        yield from done()

    parts = docs.select("text").mapInArrow(released(count), "part int, grams binary, counts binary")
    dealt = parts.repartition(max(shuffled, groups // 4), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(build), "segment int, grams long, filter binary")


# Scores.


@dataclass(frozen=True)
class Learned:
    """What the scores of a batch need besides levels."""

    total: int
    distinct: int
    frequent: dict[bytes, int]
    model: Model

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + self.model.added) / (self.total + self.model.added * (self.distinct + 1)))


_SCORED = "n_tokens long, known long, base double, score double, rare array<struct<token:binary,times:bigint>>"


def score_batch(rows: pa.Table, batch: Batch, learned: Learned, levels: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """``rows`` without their texts but with scores; ``rare`` holds the tokens that are not among the frequent ones, scored so far as unknown."""
    model = learned.model
    grams = batch.grams(model.order)
    asked, at = np.unique(np.concatenate([*grams, np.array([_START])]), return_inverse=True)
    counts = VALUES[np.where(asked == 0, 0, levels(asked))][at]
    n = len(batch.ids)
    p = (counts[:n] + model.added) / (learned.total + model.added * (learned.distinct + 1))
    for k in range(2, model.order + 1):
        own, context = counts[(k - 1) * n : k * n], np.empty(n)
        context[1:] = counts[(k - 2) * n : (k - 1) * n - 1]
        context[batch.first] = counts[-1] if k == 2 else 0.0
        p = (np.minimum(own, context) + model.prior * p) / (context + model.prior)
    exact = np.array([learned.frequent.get(w, 0) for w in batch.words], np.int64)[batch.ids]
    rare = np.nonzero(exact == 0)[0]
    text = np.searchsorted(batch.first, rare, "right") - 1
    # Few keys: a text and a token of the batch.
    keys, times = np.unique(text * len(batch.words) + batch.ids[rare].astype(np.int64), return_counts=True)
    words = pa.StructArray.from_arrays([pa.array([batch.words[k] for k in (keys % len(batch.words)).tolist()], pa.binary()), pa.array(times, pa.int64())], ["token", "times"])
    offsets = np.searchsorted(keys // len(batch.words), np.arange(rows.num_rows + 1))
    kept = rows.drop_columns("text")
    return pa.table(
        [
            *kept.columns,
            pa.array(batch.lengths),
            pa.array(batch.sums((exact > 0).astype(np.int64))),
            pa.array(batch.sums(learned.base(exact))),
            pa.array(batch.sums(np.log10(p))),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words),
        ],
        [*kept.column_names, *(c.split()[0] for c in _SCORED.split(", "))],
    )


def _schema(docs: DataFrame) -> str:
    """The columns of ``docs`` but the text, then those of the scores."""
    return ", ".join([*(f"{c} {kind}" for c, kind in docs.dtypes if c != "text"), _SCORED])


def _by_broadcast(docs: DataFrame, filters: DataFrame, segments: int, learned: Learned) -> DataFrame:
    spark, model = docs.sparkSession, learned.model
    table = filters.select("segment", "filter").toArrow()
    held = Filter.of(segments, table.column("segment").to_pylist(), table.column("filter").to_pylist(), model.hashes)
    shared = spark.sparkContext.broadcast((learned, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        for rows, batch in _batches(batches, known.model.score_tokens):
            yield from score_batch(rows, batch, known, own.levels).to_batches()

    return docs.mapInArrow(released(score), _schema(docs))


def _by_shuffle(docs: DataFrame, filters: DataFrame, segments: int, learned: Learned) -> DataFrame:
    """Texts are dealt into batches; the n-grams of a batch go to shards of the filter, and their levels back to the batch.

    A shard holds many neighbouring segments and looks up the n-grams of all batches of
    a group at once, so rows follow batches and shards and not the many small segments.
    Levels come back in the order of the sorted n-grams, which the batch makes again.
    """
    spark, model = docs.sparkSession, learned.model
    shared = spark.sparkContext.broadcast(learned)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, ceil(chars / model.batch_chars))
    size = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    shards = min(segments, _power(max(256, size / model.shard_bytes)))
    # A shard answers at most 500 batches in one group.
    salts = ceil(n / 500)
    dealt = materialize(docs.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(n))), "lm-batches")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        batch = Batch(t.as_py() for t in table.column("text")).close()
        asked = np.unique(np.concatenate([*batch.grams(model.order), np.array([_START])]))
        rows = [(key[0].as_py(), s, key[0].as_py() % salts, asked[at].tobytes()) for s, at in _cut(asked, shards)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["batch", "shard", "salt", "grams"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = Filter.of(segments, held.column("segment").to_pylist(), held.column("filter").to_pylist(), model.hashes)
        parts = [np.frombuffer(g.as_py(), np.uint64) for g in asked.column("grams")]
        ends = np.cumsum([0, *map(len, parts)])
        found = own.levels(np.concatenate([np.zeros(0, np.uint64), *parts]))
        levels = [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([asked.column("batch"), asked.column("shard"), pa.array(levels, pa.binary())], ["batch", "shard", "levels"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        levels = np.frombuffer(b"".join(answers.sort_by("shard").column("levels").to_pylist()), np.uint8)
        batch = Batch(t.as_py() for t in texts.column("text")).close()
        return score_batch(texts.drop_columns("batch"), batch, shared.value, lambda x: levels)

    asked = dealt.groupBy("batch").applyInArrow(ask, "batch long, shard int, salt long, grams binary")
    shard = F.floor(F.col("segment") / (segments // shards)).cast("int").alias("shard")
    held = filters.select("segment", "filter", shard, F.explode(F.expr(f"sequence(0L, {max(0, salts - 1)}L)")).alias("salt"))
    answers = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(answer, "batch long, shard int, levels binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, _schema(docs))


def score_documents(docs: DataFrame, held_out: F.Column, model: Model = Model()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text); learnt from rows where ``held_out`` is false.

    Null and empty texts have one token, the end.  Rows are scored by
    themselves, so repeated rows and ids, and null ids, are kept as they are.
    Without training rows no token is known, and every probability is that of a
    single unknown one: 1 before smoothing leaves 0.  Texts are whole,
    whatever their length.  An empty table gives no row; further columns are left out.
    """
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = docs.where(~F.coalesce("held_out", F.lit(False)))
    words = materialize(vocabulary(training), "lm-vocabulary")
    # Few rows: one for each doubling of the count.
    sizes = sorted(words.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    total, distinct = sum(r.n for r in sizes), sum(r.words for r in sizes)
    frequent, least = 0, None
    for r in sizes:
        if frequent + r.words > model.broadcast_tokens:
            break
        frequent, least = frequent + r.words, 1 << r.b - 1
    often = words.where(F.col("n") >= least).toArrow() if least is not None else None
    counts = dict(zip(often.column("token").to_pylist(), often.column("n").to_pylist(), strict=True)) if often is not None else {}
    learned = Learned(total, distinct, counts, model)

    segments = 1 << min(16, max(4, ceil(log2(max(1, total / model.segment_tokens)))))
    filters = materialize(build_filter(training, segments, model), "lm-filter", "uncompressed")
    size = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    score = _by_broadcast if size <= model.broadcast_bytes else _by_shuffle
    scored = materialize(score(docs.withColumn("row", F.monotonically_increasing_id()), filters, segments, learned), "lm-scored")

    # Rare tokens were scored as unknown; those of the vocabulary make up for it.
    rest = words if least is None else words.where(F.col("n") < least)
    found = scored.select("row", F.explode("rare").alias("_r")).select("row", "_r.token", "_r.times").join(rest, "token")
    gain = F.col("times") * F.log10((F.col("n") + F.lit(model.added)) / F.lit(model.added))
    more = found.groupBy("row").agg(F.sum("times").alias("_known"), F.sum(gain).alias("_gain"))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_gain", F.lit(0.0))).alias("base_score"), "score",
    )
