import math
import random

import numpy as np
import pytest

from palimpsest.llm import toxicity as T
from palimpsest.llm.common import read
from palimpsest.llm.queries import op3_toxicity

SF = "/root/testdata/sf0.01"


def vectors(pick, n, terms, most):
    out = []
    for _ in range(n):
        at = np.array(sorted(pick.sample(range(terms), pick.randrange(1, most))))
        raw = np.array([pick.choice((0.25, 0.5, 1.0, pick.random())) for _ in at])
        out.append((at, raw / math.sqrt(raw @ raw)))
    return out


@pytest.mark.parametrize("block", [1, 3, 4, 16, 64])
@pytest.mark.parametrize(("terms", "most"), [(40, 8), (400, 6), (12, 10)])
@pytest.mark.parametrize("dense_from", [0.0, 0.03, 1.0])
def test_block_index_equals_brute_force(block, terms, most, dense_from):
    pick = random.Random(block * terms)
    rows = vectors(pick, 300, terms, most) + vectors(pick, 1, terms, most) * 3
    queries = vectors(pick, 40, terms + 5, most) + [(np.zeros(0, int), np.zeros(0)), rows[0]]
    index = T.Index(rows, block, dense_from)
    full = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in rows]
    for (at, w), found in zip(queries, index.nearest(queries, 10), strict=True):
        q = dict(zip(at.tolist(), w.tolist(), strict=True))
        exact = sorted((-round(sum(v * r.get(t, 0) for t, v in q.items()), 12), i) for i, r in enumerate(full))
        exact = [(i, -s) for s, i in exact if s < 0][:10]
        assert [s for _, s in found] == pytest.approx([s for _, s in exact], abs=1e-9)
        assert sum(i == j for (i, _), (j, _) in zip(found, exact, strict=True)) >= len(exact) - 2  # rounding may part ties


def test_bounds_leave_blocks_out():
    """Blocks of another vocabulary are never scored, and nor are those of low bounds."""
    pick = random.Random(9)
    left, right = vectors(pick, 200, 30, 6), [(t + 100, w) for t, w in vectors(pick, 200, 30, 6)]
    index = T.Index(left + right, 16, 0.05)
    index.nearest(left[:50], 3)
    assert index.scored < index.seen / 2


def test_own_row_is_left_out():
    rows = vectors(random.Random(2), 30, 10, 5)
    index = T.Index(rows, 8)
    assert all(k not in [r for r, _ in near] for k, near in enumerate(index.nearest(rows, 5, list(range(30)))))


def test_held_out_and_edge_rows(spark):
    pick = random.Random(5)
    words = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(300):
        text = " ".join(pick.choices(words, k=40)) + (" vile scum" if k % 5 == 0 else "")
        rows.append((k, text))
        labels.append((k, int(k % 5 == 0)))
    rows += [(900, None), (901, ""), (902, "vile " * 5000), (902, "vile " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, marks.where("doc_id % 3 != 0"), T.Settings(min_ratio=10))
    got = {r.doc_id: r.score for r in T.score_documents(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 5 == 0) for k in range(300))
    assert got[900] == got[901] < 0.5 <= got[902]
    assert T.drop_toxic(docs, model).count() == 242
    empty = T.train(docs, marks.limit(0))
    assert {r.score for r in T.score_documents(docs, empty).collect()} == {0.0}


def test_cases(spark):
    """Text ids, repeated ids, clashing columns, very long texts, empty tables."""
    rows = [(f"d{k}", f"good words number {k}" if k % 4 else f"vile scum number {k}", "x", 1.0) for k in range(80)]
    rows += [("d0", "vile scum again", "x", 1.0), (None, None, "x", 1.0), ("long", "vile scum " * 200_000, "x", 1.0), ("same", "good words", "x", 1.0), ("same", "good words", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, evidence string, score double")
    labels = spark.createDataFrame([(f"d{k}", int(k % 4 == 0), 0.5) for k in range(80)] + [(None, 1, 0.5), ("none", 1, 0.5)], "doc_id string, toxic int, score double")
    model = T.train(docs, labels, T.Settings(min_ratio=5, neighbours=5, block=4))
    out = T.score_documents(docs, model).collect()
    assert len(out) == len(rows) and {r.doc_id: r.predicted for r in out}["long"] == 1
    assert all(r.evidence for r in out if r.doc_id)
    assert len({(r.doc_id, r.score) for r in out if r.doc_id == "same"}) == 1
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 'same'").count() == 2
    assert T.score_documents(docs.limit(0), model).count() == 0
    assert T.train(docs.limit(0), labels).index is None


def test_held_out_accuracy_and_evidence(spark):
    """On the whole of sf0.01: held-out documents are ranked by their labels, and documents with words have evidence."""
    rows = {r.doc_id: r for r in op3_toxicity(spark, SF).collect()}
    toxic = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    held = [(rows[k].score, y) for k, y in toxic.items() if k in rows and rows[k].held_out and y is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.85
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    assert len(rows) == len(texts) and sum(bool(r.evidence) for r in rows.values()) > 0.95 * sum(bool(T.words_of(t)) for t in texts.values())
