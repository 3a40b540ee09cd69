import random
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import divergence as D


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def plain(rows, a):
    docs, n, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", words(text)
        groups.add((lang, source))
        n[lang, source].update(found)
        docs.update((lang, w) for w in set(found))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [w for own, w in docs if own == lang and docs[own, w] >= a.min_documents]
        every = sum((n[g] for g in groups if g[0] == lang), Counter())

        def p(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        own, whole = p(n[lang, source]), p(every)
        pairs = [(-sum(f(own[w], q) for w, q in p(n[g]).items()), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(-f(own[w], whole[w]), w) for w in kept if n[lang, source][w] > 0 and own[w] > whole[w]]
        for part, found, top in (("pair", pairs, None), ("term", terms, a.top)):
            out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def check(spark, rows, a):
    table = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string")
    assert sorted(map(tuple, D.audit(table, a).collect())) == plain(rows, a)


@pytest.mark.parametrize("params", [D.Audit(min_documents=2, top=3, buckets=1, held=4), D.Audit(min_documents=1, top=2), D.Audit(min_documents=3)])
def test_equals_plain(spark, params):
    draw = random.Random(5)
    rows = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "d", None]), " ".join(f"w{chr(97 + min(int(draw.expovariate(0.25)), 25))}" for _ in range(draw.choice([0, 3, 40])))) for _ in range(80)]
    check(spark, rows, params)


def test_cases(spark):
    """Null and empty texts, a source and a language without terms, one source, ties, repeated rows, letters beyond ASCII, a very long text."""
    long = "the quick brown fox " * 50_000 + "x " * 3
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "1 2 3 ~"), ("en", "d", "Zz aa_zz AA"), ("en", "d", "Zz aa_zz AA"), ("en", "e", long), ("en", "f", long), ("de", "a", "Élan élan ÉLAN 日本 naïve"), ("de", "b", "élan 日本"), ("fr", "a", "seul"), (None, None, None)]
    for a in (D.Audit(min_documents=1), D.Audit(min_documents=2), D.Audit(min_documents=50)):
        check(spark, rows, a)


def test_empty(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_bound_ends_the_search(spark):
    """Buckets bounded below the k-th value are not evaluated, and the result is the same."""
    rows = [("en", "a" if k % 2 else "b", " ".join(f"t{'abcdefghij'[j]}x" for j in range(10) for _ in range((j + 1) ** 2 * (3 if (k + j) % 2 else 1)))) for k in range(12)]
    check(spark, rows, D.Audit(min_documents=1, top=1, buckets=1))
