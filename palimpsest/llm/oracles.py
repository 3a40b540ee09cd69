"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

import xxhash

from .pii import KINDS
from .quality import CUTOFFS, RULES, WINDOW

#: Words are runs of anything but ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"

# 64-bit xxHash of a long, in 128-bit arithmetic modulo 2^64 (fixed values of the hash).
_M = f"{2**64}::UHUGEINT"
_P1, _P2, _P3, _P4, _P5 = (
    f"{p}::UHUGEINT"
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turn(x: str, bits: int) -> str:
    return f"({x} * {2**bits}::UHUGEINT % {_M} + {x} // {2 ** (64 - bits)}::UHUGEINT)"


def _hash(source: str, name: str, value: str, seed: str, out: str) -> str:
    """CTEs that add ``out`` = hash of the column ``value`` under ``seed`` to the rows of ``source``; the last is ``name``."""
    return f"""
        {name}_a AS (SELECT *, ({value}::HUGEINT + 18446744073709551616) % 18446744073709551616 AS _l FROM {source}),
        {name}_b AS (SELECT *, _l::UHUGEINT * {_P2} % {_M} AS _k FROM {name}_a),
        {name}_c AS (SELECT * EXCLUDE (_l, _k), xor(({seed} + {_P5} + 8) % {_M}, {_turn("_k", 31)} * {_P1} % {_M}) AS _h FROM {name}_b),
        {name}_d AS (SELECT * EXCLUDE (_h), ({_turn("_h", 27)} * {_P1} + {_P4}) % {_M} AS _h FROM {name}_c),
        {name}_e AS (SELECT * EXCLUDE (_h), xor(_h, _h // {2**33}::UHUGEINT) * {_P2} % {_M} AS _h FROM {name}_d),
        {name}_f AS (SELECT * EXCLUDE (_h), xor(_h, _h // {2**29}::UHUGEINT) * {_P3} % {_M} AS _h FROM {name}_e),
        {name} AS (SELECT * EXCLUDE (_h), xor(_h, _h // {2**32}::UHUGEINT) AS {out} FROM {name}_f)"""


def _text_seed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42)


_CRC = """
        crc_table AS (SELECT list(c ORDER BY i) AS crc_table FROM (
            SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i))),
        bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM docs),
        summed AS (SELECT * EXCLUDE (b, crc_table), xor(list_reduce(b, lambda c, x: xor(c // 256, crc_table[1 + xor(c % 256, x)]), 4294967295), 4294967295) AS text_crc32
            FROM bytes, crc_table)"""

SHARDING = f"""WITH docs AS (SELECT row_number() OVER () AS _row, doc_id, coalesce(text, '') AS t FROM documents), {_CRC},
        shards AS (SELECT unnest([{", ".join(str(_text_seed(f"shard:{k}")) for k in range(41))}]::UHUGEINT[]) AS seed, unnest(range(41)) AS n),
        crossed AS (SELECT _row, doc_id, seed, n FROM summed, shards), {_hash("crossed", "u", "doc_id", "seed", "bits")},
        scored AS (SELECT _row, n, -1.0::DOUBLE / ln(((bits // 2048::UHUGEINT)::DOUBLE + 0.5::DOUBLE) / {2**53}::DOUBLE) AS s FROM u),
        chosen AS (SELECT _row, arg_max(n, (s, n)) FILTER (n < 40) AS shard, arg_max(n, (s, n)) AS grown FROM scored GROUP BY _row),
        {_hash("summed", "v", "doc_id", f"{_text_seed('slot')}::UHUGEINT", "first_hash")}, {_hash("v", "w", "text_crc32", "first_hash", "second_hash")}
        SELECT doc_id, strlen(t) + 16 AS size, text_crc32, 'key' AS law, shard::INT AS shard,
            row_number() OVER (PARTITION BY shard ORDER BY second_hash % 64, doc_id, text_crc32, strlen(t)) - 1 AS slot, grown::INT AS grown_shard
        FROM w JOIN chosen USING (_row)"""

JACCARD = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
        sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
        marked AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS mark, s FROM sets),
        classes AS (SELECT mark, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM marked WHERE n > 0 GROUP BY mark),
        grams AS (SELECT id, n, unnest(s) AS g FROM classes),
        links AS (SELECT x.id AS x, y.id AS y FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id
            GROUP BY x.id, y.id, x.n, y.n HAVING 185 * count(*) >= 85 * (x.n + y.n)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT id AS x, id AS y FROM classes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
        lowest AS (SELECT x AS id, min(y) AS low FROM reach GROUP BY x)
        SELECT doc_id, m.n AS n_shingles, coalesce(low, doc_id) AS component_id
        FROM marked m LEFT JOIN classes c ON c.mark = m.mark AND m.n > 0 LEFT JOIN lowest USING (id)"""



def _pii_kind(kind: str, pattern: str, valid: str, text: str = "t") -> str:
    """Matches of one kind with their place: the pieces between matches give it."""
    return f"""SELECT doc_id, '{kind}' AS kind, sum(length(piece)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, v, t
            FROM (SELECT doc_id, t, k, f[k] AS v, p[k] AS piece FROM (SELECT doc_id, t, f, p, unnest(range(1, len(f) + 1)) AS k FROM (
                SELECT doc_id, t, regexp_extract_all({text}, '{pattern}', 0) AS f, regexp_split_to_array({text}, '{pattern}') AS p FROM docs WHERE regexp_matches({text}, '{pattern}'))))
            WINDOW w AS (PARTITION BY doc_id ORDER BY k) QUALIFY {valid}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k:
            CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN {_DIGITS}[k]::INT ELSE 2 * {_DIGITS}[k]::INT - CASE WHEN {_DIGITS}[k]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
_MOVED = "(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4))"
_MOD97 = f"list_reduce(string_split({_MOVED}, ''), lambda r, c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (r * 100 + ascii(c) - 55) % 97 WHEN c BETWEEN '0' AND '9' THEN (r * 10 + ascii(c) - 48) % 97 ELSE r END, 0) = 1"
# Word borders stand for the look-around of the extra kinds, over texts of the same length.
_IBAN_TEXT = "replace(t, '_', '.')"
_SSN_TEXT = "replace(regexp_replace(t, '[^0-9-]', ' ', 'g'), '-', 'A')"

_SCORE = "CASE o " + " ".join(f"WHEN {k} THEN {x.score}::DOUBLE" for k, x in enumerate(KINDS, 1)) + " END"
_NEAR = "CASE o " + " ".join(f"WHEN {k} THEN '{x.context}'" for k, x in enumerate(KINDS, 1)) + " END"

PII = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        email AS ({_pii_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}),
        ip AS ({_pii_kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda x: least(length(ltrim(x, '0')), 4) * 1000 + CASE WHEN length(ltrim(x, '0')) BETWEEN 1 AND 3 THEN ltrim(x, '0')::INT ELSE 0 END)) <= 3255")}),
        card AS ({_pii_kind("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN)}),
        phone AS ({_pii_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
        iban AS ({_pii_kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97, _IBAN_TEXT)}),
        ssn AS ({_pii_kind("ssn", r"\b[0-9]{3}A[0-9]{2}A[0-9]{4}\b", "NOT regexp_matches(v, '^(000|666|9)|A00A|A0000$')", _SSN_TEXT)}),
        every AS (SELECT 1 AS o, * FROM email UNION ALL SELECT 2, * FROM ip UNION ALL SELECT 3, * FROM card UNION ALL SELECT 4, * FROM phone UNION ALL SELECT 5, * FROM iban
            UNION ALL SELECT 6, * FROM ssn WHERE regexp_matches(lower(substr(t, greatest(start - 48, 0)::BIGINT + 1, least(start, 48)::BIGINT)), 'ssn|social|security')),
        told AS (SELECT doc_id, o, start, kind, kind || ':' || start || ':' || (start + length(v)) AS s,
            least(1.0::DOUBLE, {_SCORE} + CASE WHEN regexp_matches(lower(substr(t, greatest(start - 48, 0)::BIGINT + 1, least(start, 48)::BIGINT)), {_NEAR}) THEN 0.3::DOUBLE ELSE 0 END) AS score FROM every),
        sums AS (SELECT doc_id, count(*) FILTER (o = 1) AS e, count(*) FILTER (o = 2) AS i, count(*) FILTER (o = 3) AS c, count(*) FILTER (o = 4) AS p,
            string_agg(s, ',' ORDER BY o, start) FILTER (o <= 4) AS base, string_agg(s, ',' ORDER BY o, start) AS spans, count(*) AS n, max(score) AS best FROM told GROUP BY doc_id)
        SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans, round(best, 6) AS best_score FROM docs LEFT JOIN sums USING (doc_id)"""


def _quality() -> str:
    cells = ", ".join(
        f"('{rule}', {cutoff}::DOUBLE, {top}::DOUBLE / nullif({bottom}, 0) > {cutoff}::DOUBLE)"
        for rule, (top, bottom) in ((r, e.split(" / ")) for r, e in RULES.items())
        for cutoff in CUTOFFS
    )
    each, tests = 0.05 / len(RULES), len(RULES) * len(CUTOFFS)
    return f"""WITH docs AS (SELECT row_number() OVER () AS _row, doc_id, lang, coalesce(text, '') AS t FROM documents),
        split AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs),
        windows AS (SELECT _row, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT _row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
        twice AS (SELECT _row, i FROM windows QUALIFY count(*) OVER (PARTITION BY _row, g) > 1),
        covered AS (SELECT _row, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM (SELECT _row, i, lead(i) OVER (PARTITION BY _row ORDER BY i) AS next FROM twice) GROUP BY _row),
        feats AS (SELECT _row, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
            length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (_row)),
        verdicts AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        tried AS (SELECT _row, lang, bad, unnest([{cells}]) AS c FROM feats LEFT JOIN verdicts USING (doc_id)),
        cells AS (SELECT _row, lang, bad, c[1] AS rule, c[2] AS cutoff, coalesce(c[3], false) AS over FROM tried),
        counts AS (SELECT lang, rule, cutoff, count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS poor, count(*) FILTER (NOT bad AND over) AS wrong,
            count(*) FILTER (bad AND over) AS hit, (SELECT count(DISTINCT coalesce(lang, '')) FROM feats JOIN verdicts USING (doc_id)) AS strata FROM cells WHERE bad IS NOT NULL GROUP BY ALL),
        tails AS (SELECT *, list_sum(list_transform(range(0, wrong + 1), lambda i:
            exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({each}::DOUBLE) + (good - i) * ln(1 - {each}::DOUBLE)))) AS p FROM counts WHERE good > 0 AND wrong < {each}::DOUBLE * good),
        gains AS (SELECT *, hit::DOUBLE / greatest(poor, 1) - 10.0::DOUBLE * wrong / good AS gain FROM tails WHERE p <= 0.05::DOUBLE / (strata * {tests})),
        best AS (SELECT lang, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM gains WHERE gain > 0 GROUP BY ALL),
        rejected AS (SELECT DISTINCT _row FROM cells JOIN best ON best.lang IS NOT DISTINCT FROM cells.lang AND best.rule = cells.rule AND best.cutoff = cells.cutoff WHERE over)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR rejected._row IS NOT NULL) AS kept FROM feats LEFT JOIN rejected USING (_row)"""


QUALITY = _quality()


NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.r != b.r WHERE a.vec_id % 50 = 0),
        positives AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM scores WHERE same QUALIFY k <= 5)
        SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.id))::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""

DIVERGENCE = """WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        found AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS ln FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        grid AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p, 1 + (1000000000::HUGEINT * (ln + 2)) // (lt + 2 * v) AS q
            FROM totals g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM grid WHERE n > 0 AND p > q),
        every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 10"""
