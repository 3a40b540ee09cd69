"""The pipeline: rows that repeat ids, every stage against plain Python, empty tables and clashing columns."""

import math
import re
from collections import Counter

import corpus_pipeline as P
from palimpsest.llm import pii
from palimpsest.llm import quality as Q
from palimpsest.llm import toxicity as T
from palimpsest.llm.common import materialize, read
from palimpsest.llm.queries import vocabulary


def text(seed, n=60):
    return " ".join(f"w{seed}x{k}" for k in range(n))


def test_rows_that_repeat_an_id_are_grouped_by_their_own_texts(spark):
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (2, text(2)), (3, text(3)), (4, text(3)), (None, text(3)), (None, text(3)), (5, ""), (5, ""), (5, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    wanted = [(1, text(1)), (1, text(2)), (3, text(3)), (None, text(3)), (None, text(3)), (5, ""), (5, text(4))]
    assert sorted(kept, key=repr) == sorted(wanted, key=repr)


def test_quality_verdicts_stay_with_their_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} the" for k in range(100))
    rows = [(1, good, "en"), (1, "# # # #", "en"), (None, "# # # #", "en"), (None, good, None), (2, good, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(((r.doc_id, r.text) for r in P.drop_low_quality(spark, docs, str(tmp_path)).collect()), key=repr)
    assert kept == sorted([(1, good), (None, good), (2, good)], key=repr)


# -- every stage against plain Python, each on all rows of its input ------------------

SF = "/root/testdata/sf0.001"


def plain_features(t):
    """(value of each rule, fails a base rule) of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    chars = sum(map(len, words))
    n = len(words)
    tops = {"symbols": (sum(c in "#*$%&|<>" for c in t), n), "dup_lines": (len(lines) - len(set(lines)), len(lines)), "repeats": (len(covered), n), "shouting": (sum("A" <= c <= "Z" for c in t), chars), "bangs": (t.count("!"), n)}
    return {r: a / b if b else None for r, (a, b) in tops.items()}, n < 20 or 100 * len(covered) > 30 * n


def plain_cutoffs(rows, alpha=0.05, delta=0.05):
    """Certified cutoffs by exact sums over the labelled (stratum, features, bad)."""
    strata = {s for s, _, _ in rows}
    each, out = alpha / len(Q.RULES), {}
    for s in strata:
        good = [f for x, f, bad in rows if x == s and not bad]
        poor = [f for x, f, bad in rows if x == s and bad]
        for rule in Q.RULES:
            best = None
            for cutoff in Q.CUTOFFS:
                wrong, right = (sum(f[rule] is not None and f[rule] > cutoff for f in part) for part in (good, poor))
                if not good or wrong >= each * len(good):
                    continue
                p = sum(math.comb(len(good), i) * each**i * (1 - each) ** (len(good) - i) for i in range(wrong + 1))
                gain = right / max(len(poor), 1) - 10.0 * wrong / len(good)
                if p <= delta / (len(strata) * len(Q.RULES) * len(Q.CUTOFFS)) and gain > 0:
                    best = max(best or (0, 0), (gain, cutoff))
            if best:
                out[s, rule] = best[1]
    return out


def plain_quality(docs, labels):
    bad = {}
    for k, q in labels:
        if k is not None and q is not None:
            bad[k] = bad.get(k, False) or q == 0
    told = [(r, *plain_features(r.text or "")) for r in docs]
    cutoffs = plain_cutoffs([(r.lang, f, bad[r.doc_id]) for r, f, _ in told if r.doc_id in bad])
    return cutoffs, [r for r, f, failed in told if not failed and not any(f[rule] is not None and (s := cutoffs.get((r.lang, rule))) is not None and f[rule] > s for rule in Q.RULES)]


def plain_groups(docs, n=5):
    sets = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return [r for r in docs if find(r.doc_id) == r.doc_id]


def plain_redaction(text, spans):
    out, at = [], 0
    for start, end, kind in sorted((s.start, s.end, s.kind) for s in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def ids(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_every_stage_against_plain_python(spark):
    from tokenizers import Tokenizer

    labels = read(spark, SF, "labels")
    marks = labels.collect()
    docs = read(spark, SF, "documents")
    rows = docs.collect()
    model = T.train(docs.select("doc_id", "text"), labels)
    scores = model.score([r.text for r in rows])
    after = materialize(P.drop_toxic(spark, docs, SF), "test-toxicity")
    assert after.columns == docs.columns and ids(after.collect()) == ids([r for r, (p, _) in zip(rows, scores, strict=True) if p < 0.5])
    rows = after.collect()
    _, kept = plain_quality(rows, [(m.doc_id, m.quality) for m in marks])
    after = materialize(P.drop_low_quality(spark, after, SF), "test-quality")
    assert ids(after.collect()) == ids(kept)
    after = materialize(P.drop_near_duplicates(spark, after, SF), "test-duplicates")
    assert ids(after.collect()) == ids(plain_groups(kept)) and after.count() < len(kept)
    found = {r.doc_id: r["_spans"] for r in pii.find_spans(after).collect()}
    before = after.collect()
    after = materialize(P.redact_personal_data(spark, after, SF), "test-personal")
    assert ids(after.collect()) == sorted((r.doc_id, plain_redaction(r.text, found[r.doc_id])) for r in before)
    assert all(r.n_chars == len(r.text) for r in after.collect()) and after.columns == docs.columns
    library = Tokenizer.from_file(vocabulary())
    pieces = {}
    for r in P.pack(spark, after, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in after.collect():
        assert [i for _, part in sorted(pieces[r.doc_id]) for i in part] == [*library.encode(r.text, add_special_tokens=False).ids, 2]


def test_run_takes_all_stages(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    rows = P.run(spark, SF).collect()
    assert rows and {r.length for r in rows} <= {1 << k for k in range(13)} and len({r.sequence_id for r in rows}) == len(rows)


def test_certified_cutoffs_reject(spark, tmp_path):
    """Cutoffs that labels certify reject rows beyond the base rules, as plain Python says."""
    rows = [(k, text(k, 30 + k % 9) + (" !" if k % 90 == 0 else ""), "en") for k in range(2200)] + [(5000 + k, " ".join(f"w{k}x{j}***" for j in range(40)), "en") for k in range(60)]
    rows += [(7000 + k, " ".join(f"v{k}x{j}&&&&" for j in range(40)), lang) for k, lang in enumerate(("en", "de", None))]
    spark.createDataFrame([(k, int(k < 5000), 0) for k, _, _ in rows if k < 7000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cutoffs, kept = plain_quality(docs.collect(), [(k, int(k < 5000)) for k, _, _ in rows if k < 7000])
    assert ("en", "symbols") in cutoffs and {r.doc_id for r in kept} >= {7001, 7002} and 7000 not in {r.doc_id for r in kept}
    assert ids(P.drop_low_quality(spark, docs, str(tmp_path)).collect()) == ids(kept)
    judged = Q.judge(docs, read(spark, str(tmp_path), "labels"))
    assert {r.doc_id for r in judged.where("kept").collect()} == {r.doc_id for r in kept} and judged.where("NOT kept AND NOT base_failed").count() > 50


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, _row string, part string, ids string, _t string"
    one = [(1, text(1), "en", "s", 3, 4, True, 0.5, "r", "p", "i", "t"), (2, text(1), None, None, None, None, None, None, None, None, None, None)]
    for rows, wanted in (([], 0), (one, 1)):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), "test-" + name)
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
        assert docs.count() == wanted and P.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= wanted
