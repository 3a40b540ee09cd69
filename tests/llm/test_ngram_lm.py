import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_lm as M
from palimpsest.llm.common import fold
from palimpsest.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 700} the" for k in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a b a b a"), (4, "a b a b a"), (None, "A BÉ bé"), (6, LONG), (7, "a b a b a"), (-8, "b"), (9, "only held\x00out\x1fwords a")]


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return [*out, ""]


def plain(rows, held, order, prior=M.Model.prior):
    """Scores with dictionaries of counts, kept as powers of two in the model."""
    grams = [Counter() for _ in range(order)]
    exact = Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            own = ["<start>", *words(text)]
            exact.update(own[1:])
            for n in range(1, order + 1):
                grams[n - 1].update(tuple(own[k - n + 1 : k + 1]) for k in range(n > 1 or 0, len(own)) if k - n + 1 >= 0)
    total, distinct = sum(exact.values()), len(exact)

    def value(gram):
        c = grams[len(gram) - 1][gram]
        low = 1 << c.bit_length() - 1 if c else 0
        return math.sqrt(low * (2 * low - 1))

    found = []
    for _, text in rows:
        own = ["<start>", *words(text)]
        base = sum(math.log10((exact[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own[1:])
        score = 0.0
        for k in range(1, len(own)):
            p = (value((own[k],)) + 0.1) / (total + 0.1 * (distinct + 1))
            for n in range(2, min(order, k + 1) + 1):
                context = value(tuple(own[k - n + 1 : k]))
                p = (min(value(tuple(own[k - n + 1 : k + 1])), context) + prior * p) / (context + prior)
            score += math.log10(p)
        found.append((len(own) - 1, sum(exact[w] > 0 for w in own[1:]), total, base, score))
    return found


def check(spark, rows, model):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long").coalesce(2)
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    got = M.score_documents(docs, fold("doc_id", 10) == 0, model).collect()
    wanted = plain(rows, held, model.order)
    key = lambda r: (repr(r[0]), *r[2:5], round(r[5], 4))
    got = sorted(map(tuple, got), key=key)
    wanted = sorted(((r[0], h, *w) for r, h, w in zip(rows, held, wanted, strict=True)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in wanted], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_dictionaries(spark, order, small):
    """With 24 hashes an error is beyond reach; ``small`` sends n-grams and rare tokens through shuffles."""
    check(spark, EDGE, M.Model(order=order, hashes=24, bits=40, batch_tokens=40_000, score_tokens=40_000, **({"broadcast_bytes": 0, "broadcast_tokens": 3, "batch_chars": 50_000} if small else {})))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("small", [False, True])
def test_documents_equal_dictionaries(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, M.Model(hashes=24, bits=40, **({"broadcast_bytes": 0, "broadcast_tokens": 500, "batch_chars": 100_000} if small else {})))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    """As registered: whole table, base exact, and held-out texts likelier than under single tokens."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_language_model"](spark, DATA).collect()))
    held = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    wanted = sorted((r[0], h, *w) for r, h, w in zip(rows, held, plain(rows, held, 2), strict=True))
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)
    # Errors of the filter can only raise counts, and rarely.
    assert np.mean([abs(g[6] - w[6]) for g, w in zip(got, wanted, strict=True)]) < 0.03 * np.mean([abs(w[6]) for w in wanted])
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_filter_errors():
    """No entry is lost, and unknown n-grams are found as rarely as the number of hashes says."""
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(1, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.7, len(grams)), 1 << 40)
    parts = {s: M.segment_filter(grams[at], counts[at], 6, 9) for s, at in M._cut(grams, 16)}
    held = M.Filter.of(16, list(parts), list(parts.values()), 6)
    assert (held.levels(grams) >= M.level_of(counts)).all()
    assert (held.levels(grams) > M.level_of(counts)).mean() < 0.03
    other = np.unique(rng.integers(1, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (held.levels(other) > 0).mean() < 0.03
    assert sum(map(len, parts.values())) <= M.level_of(counts).sum() * 9 / 8 + 16 * 8


def test_levels_and_empty(spark):
    assert M.level_of(np.array([1, 2, 3, 4, 7, 8, (1 << 40) - 1, 1 << 40])).tolist() == [1, 2, 2, 3, 3, 4, 40, 41]
    empty = spark.createDataFrame([], "doc_id long, text string")
    for model in (M.Model(), M.Model(broadcast_bytes=0)):
        assert M.score_documents(empty, F.lit(False), model).collect() == []
    only = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, row string")
    got = {r.doc_id: r for r in M.score_documents(only, F.lit(True)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0) and got[2].n_tokens == 1
