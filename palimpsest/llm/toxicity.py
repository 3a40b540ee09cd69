"""Toxicity by nearest labelled examples.

Labelled examples become TF-IDF vectors over all their words and the beginnings
of longer words.  Inverse document frequencies count all documents; a term's weight
grows with the square root of its log-likelihood ratio where toxic examples
have more of it, and no term is left out.  The nearest examples by exact cosine
come from an inverted index with block maxima: examples are numbered in blocks
of like texts, and each term keeps the largest weight of every block.  The block
with the largest upper bound is scored first; then only the blocks whose bound reaches
the k-th similarity found, so that none that could enter the result is
left out.  Terms that many examples hold lie in a dense table, whose bounds and
scores are matrix products over many texts at a time; all others lie in lists.
Votes weighted by similarity are calibrated on the examples
themselves, each left out of its own neighbours.

Bound: ``Settings.examples`` labelled rows (the smallest hashes of the ids) form
the model, a documented parameter, so the model's size does not depend on the
corpus.

Cases: null or empty text, or text without any term of the examples, has no
neighbours and gets the calibrated share of toxic examples without terms; ties in similarity
go to the smaller example number; rows that repeat get equal scores; without
labels every score is 0; an id with several labels counts as toxic if one of
them says so, and an id with several texts teaches by its smallest; ids may be
of any type; a very long text is one vector of its distinct terms; only the id and the text
are read, so further columns of any name do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, release

_WORD = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class Settings:
    examples: int = 2_000
    #: Log-likelihood ratio (chi-squared, one degree) at which a term's weight is doubled.
    min_ratio: float = 25.0
    #: Lengths of the beginnings that are terms beside the word.
    beginnings: tuple[int, ...] = (5,)
    neighbours: int = 15
    block: int = 64
    #: A term lies in the dense table if it is in this part of the examples.
    dense_from: float = 0.04
    #: Texts whose vectors are searched together.
    together: int = 96


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


#: Entries of the lists that are added up at once.
ENTRIES = 50_000
#: Term numbers and their weights.
Vector = tuple[np.ndarray, np.ndarray]
#: Rows and their similarities, the nearest first.
Near = list[tuple[int, float]]


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each, as 32-bit numbers."""
    n = end - start
    before = np.cumsum(n) - n
    part = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(len(part), dtype=np.int32) + (start - before).astype(np.int32)[part], part


class Index:
    """Exact top-k by cosine over example vectors, with block maxima."""

    def __init__(self, vectors: Iterable[Vector], block: int, dense_from: float = 1.0):
        """``vectors`` are of unit length, each with its terms ascending."""
        pairs = list(vectors)
        self.block = block
        self.rows = len(pairs)
        self.blocks = -(-self.rows // block)
        terms = np.concatenate([t for t, _ in pairs] or [[]]).astype(np.int32)
        weights = np.concatenate([w for _, w in pairs] or [[]])
        at = np.repeat(np.arange(self.rows, dtype=np.int32), [len(t) for t, _ in pairs])
        del pairs
        self.terms = int(terms.max()) + 1 if len(terms) else 0
        often = np.flatnonzero(np.bincount(terms, minlength=self.terms) > dense_from * self.rows)
        #: Column of each term in the dense table, or -1.
        self.column = np.full(self.terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        held = self.column[terms] >= 0
        self.dense = np.zeros((self.rows, len(often)))
        self.dense[at[held], self.column[terms[held]]] = weights[held]
        self.dense_most = np.maximum.reduceat(self.dense, np.arange(0, self.rows, block)) if self.rows else self.dense
        terms, at, weights = terms[~held], at[~held], weights[~held]
        order = np.argsort(terms, kind="stable")
        terms, self.at, self.weights = terms[order], at[order], weights[order]
        # An entry is a term in a block; its rows lie together.
        blocks = self.at // block
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        first = np.flatnonzero(new)
        self.entry_block = blocks[first]
        self.entry_most = np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        self.entry_start = np.append(first, len(terms)).astype(np.int32)
        self.term_start = np.searchsorted(terms[first], np.arange(self.terms + 1)).astype(np.int32)
        #: Blocks, and of them those that were scored, of all searches; tells whether the bounds prune.
        self.seen = self.scored = 0

    def nearest(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[Near]:
        """For each query the k rows of greatest positive similarity, the smaller row first among equals, without its own row of ``without``."""
        out: list[Near] = [[] for _ in queries]
        if not queries or not self.rows:
            return out
        n = len(queries)
        terms = np.concatenate([t for t, _ in queries]).astype(np.int32)
        q = np.concatenate([w for _, w in queries])
        of = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        known = terms < self.terms
        terms, q, of = terms[known], q[known], of[known]
        column = self.column[terms]
        held = column >= 0
        dense = np.zeros((n, self.dense.shape[1]))
        dense[of[held], column[held]] = q[held]
        terms, q, of = terms[~held], q[~held], of[~held]
        entry, part = _spread(self.term_start[terms], self.term_start[terms + 1])
        query, q = of[part], q[part]
        block = self.entry_block[entry]
        bound = dense @ self.dense_most.T + np.bincount(query * self.blocks + block, q * self.entry_most[entry], n * self.blocks).reshape(n, self.blocks)
        scores = np.zeros((n, self.rows))

        def score(chosen: np.ndarray) -> None:
            """The similarities of the chosen (query, block)."""
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                rows, own = slice(b * self.block, (b + 1) * self.block), chosen[:, b]
                if 2 * np.count_nonzero(own) > n:
                    scores[own, rows] = (dense @ self.dense[rows].T)[own]
                else:
                    scores[own, rows] = dense[own] @ self.dense[rows].T
            kept = np.flatnonzero(chosen[query, block])
            # A few entries at a time, as the rows they hold are many more.
            for a in range(0, len(kept), ENTRIES):
                some = kept[a : a + ENTRIES]
                held = entry[some]
                place, part = _spread(self.entry_start[held], self.entry_start[held + 1])
                first = (query[some] * self.rows).astype(np.int32)
                np.add.at(scores.reshape(-1), first[part] + self.at[place], self.weights[place] * q[some][part])
            if without is not None:
                scores[np.arange(n), without] = 0

        def floors() -> np.ndarray:
            """The k-th similarity of each query so far."""
            return np.partition(scores, -k, axis=1)[:, -k:][:, :1] if k <= self.rows else np.zeros((n, 1))

        # The most promising block sets the similarity to beat ...
        lead = np.zeros((n, self.blocks), bool)
        lead[np.arange(n), bound.argmax(axis=1)] = True
        score(lead)
        # ... and only blocks whose bound reaches it are scored beside it.
        rest = (bound > 0) & (bound >= floors() - 1e-9) & ~lead
        score(rest)
        self.seen += n * self.blocks
        self.scored += int(lead.sum() + rest.sum())
        query, row = np.nonzero((scores > 0) & (scores >= floors() - 1e-12))
        value = scores[query, row]
        order = np.lexsort((row, -np.round(value, 12), query))  # sums that should be equal differ in the last bits
        for i, r, s in zip(query[order].tolist(), row[order].tolist(), value[order].tolist(), strict=True):
            if len(out[i]) < k:
                out[i].append((r, s))
        return out


class Terms:
    """The distinct words of the examples, then their beginnings of each length; a term's number is its place."""

    def __init__(self, words: pa.Array, s: Settings):
        self.sets = [words]
        for n in s.beginnings:
            self.sets.append(pc.unique(pc.utf8_slice_codeunits(words.filter(pc.greater_equal(pc.utf8_length(words), n)), 0, n)))
        self.lengths = (0, *s.beginnings)
        self.firsts = [0, *np.cumsum([len(x) for x in self.sets]).tolist()]

    def __len__(self) -> int:
        return self.firsts[-1]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """For each kind of term and word its number, or -1."""
        out = np.empty((len(self.sets), len(words)), np.int64)
        for k, (known, n, first) in enumerate(zip(self.sets, self.lengths, self.firsts, strict=False)):
            keys = words if not n else pc.utf8_slice_codeunits(words, 0, n)
            if n:
                keys = pc.if_else(pc.greater_equal(pc.utf8_length(words), n), keys, pa.scalar(None, keys.type))
            found = pc.fill_null(pc.index_in(keys, value_set=known, skip_nulls=True), -1).to_numpy()
            out[k] = np.where(found < 0, -1, found + first)
        return out


def term_counts(texts: Sequence[str | None], terms: Terms) -> list[Vector]:
    """For each text the numbers of its terms, ascending, and their occurrences; each distinct word is looked up once."""
    words = [words_of(t) for t in texts]
    coded = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
    width, size = max(len(coded.dictionary), 1), max(len(terms), 1)
    row = np.repeat(np.arange(len(words)), list(map(len, words)))
    key, times = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = np.divmod(key, width)
    found = terms.numbers(coded.dictionary)[:, code]
    known = found >= 0
    key = (row * size + found)[known]
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.broadcast_to(times, found.shape)[known][order]
    if len(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, times = key[first], np.add.reduceat(times, first)
    row, term = np.divmod(key, size)
    edges = np.searchsorted(row, np.arange(len(words) + 1)).tolist()
    return [(term[a:b], times[a:b]) for a, b in pairwise(edges)]


@dataclass
class Model:
    """Terms, their weights, the index and the calibration."""

    settings: Settings
    terms: Terms
    #: Inverse document frequency, raised by the labels.
    weight: np.ndarray
    toxic: list[int] = field(default_factory=list)
    ids: list = field(default_factory=list)
    index: Index | None = None
    #: Share of toxic examples among those without any term.
    empty_score: float = 0.0
    #: Rising steps (vote up to, probability).
    steps: list[tuple[float, float]] = field(default_factory=list)
    #: Terms and their occurrences in the indexed examples, end to end, and where each example ends.
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        """Without the index, which is several times as large as what it is made from."""
        return {**self.__dict__, "index": None}

    def searchable(self) -> Index | None:
        """The index, made anew in a worker."""
        if self.index is None and self.held is not None:
            terms, times, ends = self.held
            pairs = zip(np.split(terms, ends[:-1]), np.split(times, ends[:-1]), strict=True)
            self.index = Index((self.unit(p) for p in pairs), self.settings.block, self.settings.dense_from)
            release()  # what was needed to make it is as large again
        return self.index

    def free(self) -> None:
        """Let go of the tables, in a worker whose task is over; every task gets a model of its own."""
        self.index, self.held, self.weight = None, None, np.zeros(0)
        release()

    def vectors(self, texts: Sequence[str | None]) -> list[Vector]:
        """Unit TF-IDF vectors; logarithmic term frequency."""
        return [self.unit(c) for c in term_counts(texts, self.terms)]

    def unit(self, counts: Vector) -> Vector:
        terms, times = counts
        raw = (1 + np.log(times)) * self.weight[terms]
        return terms, raw / math.sqrt(raw @ raw) if len(raw) else raw

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """Steps from (vote, toxic) of the examples."""
        # Pool adjacent violators: probabilities that rise with the vote.
        pools: list[list[float]] = []
        for vote, toxic in sorted(votes):
            pools.append([vote, toxic, 1])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
                top, y, n = pools.pop()
                pools[-1] = [top, pools[-1][1] + y, pools[-1][2] + n]
        self.steps = [(top, (y + 0.5) / (n + 1)) for top, y, n in pools]

    def _vote(self, near: Near) -> float:
        total = sum(s for _, s in near)
        return sum(s for r, s in near if self.toxic[r]) / total if total else 0.0

    def score(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """(probability, evidence) of each text: the evidence are (example id, similarity)."""
        k, step, out = self.settings.neighbours, self.settings.together, []
        all_vectors = self.vectors(texts)
        for a in range(0, len(texts), step):
            vectors = all_vectors[a : a + step]
            index = self.searchable()
            found = index.nearest(vectors, k) if index else [[]] * len(vectors)
            out += [(self._probability(near), [(self.ids[r], s) for r, s in near]) for near in found]
        return out

    def _probability(self, near: Near) -> float:
        if not near:
            return self.empty_score
        vote = self._vote(near)
        p = next((p for top, p in self.steps if vote <= top), self.steps[-1][1])
        # A small part of the vote keeps the order inside a step.
        return p * (1 - 1e-3) + 1e-3 * vote


def fit(examples: list[tuple], terms: Terms, spread: np.ndarray, documents: float, settings: Settings) -> Model:
    """Model from (id, toxic, term counts), all terms, the documents that hold each term, and their number."""
    model = Model(settings, terms, np.zeros(0))
    counts = [c for _, _, c in examples]
    toxic = [y for _, y, _ in examples]
    rows, bad = np.zeros(len(terms)), np.zeros(len(terms))
    for (held, _), y in zip(counts, toxic, strict=True):
        rows[held] += 1
        if y:
            bad[held] += 1
    ratio = likelihood_ratio(rows, bad, len(toxic), sum(toxic))
    model.weight = (np.log((1 + documents) / (1 + spread)) + 1) * (1 + np.sqrt(ratio / settings.min_ratio))
    bare = [y for (held, _), y in zip(counts, toxic, strict=True) if not len(held)]
    model.empty_score = sum(bare) / (len(bare) + 2)
    # Texts that share their most frequent terms share blocks, so that the bounds of other blocks are small.
    kept = sorted((k for k, (held, _) in enumerate(counts) if len(held)), key=lambda k: (tuple(sorted(counts[k][0][np.argsort(-counts[k][1] * (spread[counts[k][0]] + 1), kind="stable")[:3]].tolist())), k))
    model.ids, model.toxic = [examples[k][0] for k in kept], [toxic[k] for k in kept]
    if kept:
        model.held = (*(np.concatenate([counts[k][j] for k in kept]).astype(np.int32) for j in (0, 1)), np.cumsum([len(counts[k][0]) for k in kept]))
    vectors = [model.unit(counts[k]) for k in kept]
    model.index = Index(vectors, settings.block, settings.dense_from)
    votes = []
    for a in range(0, len(vectors), settings.together):
        part = vectors[a : a + settings.together]
        near = model.index.nearest(part, settings.neighbours, list(range(a, a + len(part))))
        votes += [(model._vote(n), y) for n, y in zip(near, model.toxic[a : a + len(part)], strict=True)]
    model.calibrate(votes)
    return model


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the labelled rows; ``labels`` has (doc_id, toxic) of the rows to learn from.

    The driver holds the words of ``settings.examples`` texts; everything that
    follows the corpus (how many documents hold each term) is summed on the
    executors.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(settings.examples)
    sample = documents.sparkSession.createDataFrame(sample.collect(), sample.schema).coalesce(1)
    # At most settings.examples rows of two small values; one text for each id.
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([words_of(t.as_py()) for t in batch.column(2)], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = texts.select("doc_id", "toxic", "text").mapInArrow(example_words, f"doc_id {kind}, toxic int, words array<string>").toArrow()
    if not held.num_rows:
        return Model(settings, Terms(pa.array([], pa.large_string()), settings), np.zeros(0))
    held = held.sort_by("doc_id")
    words = pc.unique(pa.chunked_array([b.column("words").flatten() for b in held.to_batches()], pa.string())).cast(pa.large_string())
    terms = Terms(words.sort(), settings)
    examples = []
    for batch in held.to_batches(max_chunksize=256):
        counts = term_counts([" ".join(words) for words in batch.column(2).to_pylist()], terms)
        examples += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts, strict=True)
    del held, batch, words

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(len(terms) + 1, np.int64)  # the last counts the documents
        for batch in batches:
            for part in parts(batch.column(0)):
                rows[:-1] += np.bincount(np.concatenate([t for t, _ in term_counts(part, terms)]), minlength=len(terms))
            rows[-1] += batch.num_rows
        found = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows[found])], ["term", "n"])
        release()

    spread = np.zeros(len(terms) + 1)
    found = documents.select("text").mapInArrow(document_rows, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    spread[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return fit(examples, terms, spread[:-1], spread[-1], settings)


def likelihood_ratio(rows: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> np.ndarray:
    """G-squared of each term's presence against the label; 0 where toxic examples do not have more of it."""

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.where(observed > 0, observed, 1) / np.where(observed > 0, expected, 1))

    good, n_good, share = rows - bad, n - n_bad, rows / n
    both = part(bad, share * n_bad) + part(good, share * n_good) + part(n_bad - bad, (1 - share) * n_bad) + part(n_good - good, (1 - share) * n_good)
    return np.where(bad * n > rows * n_bad, np.maximum(2 * both, 0), 0)


def score_documents(documents: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            rows = scored(model, batch.column(1), known)
            scores = [p for p, _ in rows]
            why = [[f"{i}:{s:.4f}" for i, s in near] for _, near in rows]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(why, pa.list_(pa.string()))], ["doc_id", "score", "predicted", "evidence"])
        known.clear()
        model.free()

    out = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<string>")
    return out if evidence else out.drop("evidence")


def scored(model: Model, texts: pa.Array, known: dict[bytes, tuple]) -> list[tuple[float, list]]:
    """Scores and the three nearest of each text; the answers for equal texts are kept, up to a bound."""
    if len(known) > 5_000:
        known.clear()
    out: list[tuple[float, list]] = []
    for part in parts(texts):
        keys = [sha256(t.encode("utf-8", "surrogatepass")).digest() for t in part]
        fresh = {key: text for key, text in zip(keys, part, strict=True) if key not in known}
        for key, (p, near) in zip(fresh, model.score(list(fresh.values())), strict=True):
            known[key] = p, near[:3]
        out += [known[key] for key in keys]
        release()
    return out


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """Rows whose score is below 0.5, with all their columns; nothing is shuffled."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            yield batch.filter(pa.array([p < 0.5 for p, _ in scored(model, batch.column(at), known)], pa.bool_()))
        known.clear()
        model.free()

    return documents.mapInArrow(run, documents.schema)
