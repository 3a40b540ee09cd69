"""DuckDB SQL for the queries of matching and clean-up by joins."""

from __future__ import annotations

from .oracles import _EVENTS

#: Properties of both sides of each pair of events, the pairs that are equal, and what is mapped to what.
_SIDES = f"""{_EVENTS}, l0 AS (SELECT b AS key, src AS t FROM e WHERE src IS NOT NULL AND dst IS NOT NULL), r0 AS (SELECT b AS key, dst AS t FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
    l1 AS (SELECT key, unnest(json_keys(t)) AS name, generate_subscripts(json_keys(t), 1) AS i, t FROM l0 WHERE len(json_keys(t)) > 0),
    r1 AS (SELECT key, unnest(json_keys(t)) AS name, generate_subscripts(json_keys(t), 1) AS i, t FROM r0 WHERE len(json_keys(t)) > 0),
    l AS (SELECT key, i, name, (t -> ('$."' || name || '"'))::VARCHAR AS value FROM l1), r AS (SELECT key, i, name, (t -> ('$."' || name || '"'))::VARCHAR AS value FROM r1),
    ln AS (SELECT l0.key, count(i) AS n, coalesce(string_agg(name || chr(1) || value, chr(2) ORDER BY i), '') AS s FROM l0 LEFT JOIN l ON l.key = l0.key GROUP BY l0.key),
    rn AS (SELECT r0.key, count(i) AS n, coalesce(string_agg(name || chr(1) || value, chr(2) ORDER BY i), '') AS s FROM r0 LEFT JOIN r ON r.key = r0.key GROUP BY r0.key),
    sizes AS (SELECT ln.key, ln.n, rn.n AS m, ln.s = rn.s AS whole FROM ln JOIN rn ON ln.key = rn.key),
    equal AS (SELECT l.key, l.i AS x, r.i AS y, n, m, whole FROM l JOIN r ON l.key = r.key AND l.name = r.name AND l.value = r.value JOIN sizes s ON s.key = l.key)"""

#: Trees of blocks of four lines, lines and words.
_WORDS = """w AS (SELECT doc_id AS key, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS row FROM documents),
    v AS (SELECT key, row, list_filter(string_split(line, ' '), lambda x: x != '') AS ws FROM w),
    every AS (SELECT doc_id AS key, -1 AS b, -1 AS r, -1 AS c, '' AS label FROM documents
        UNION ALL SELECT DISTINCT key, row // 4, -1, -1, '' FROM v UNION ALL SELECT key, row // 4, row, -1, '' FROM v
        UNION ALL SELECT key, row // 4, row, unnest(range(0, len(ws))), unnest(ws) FROM v WHERE len(ws) > 0),
    ids AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b, r, c) - 1 AS id FROM every),
    sized AS (SELECT *, CASE WHEN b < 0 THEN count(*) OVER (PARTITION BY key) WHEN r < 0 THEN count(*) OVER (PARTITION BY key, b) WHEN c < 0 THEN count(*) OVER (PARTITION BY key, b, r) ELSE 1 END AS size,
            max(r) OVER (PARTITION BY key) AS last_of_all, max(r) OVER (PARTITION BY key, b) AS last_of_block,
            CASE WHEN b < 0 THEN -1 WHEN r < 0 THEN 0 WHEN c < 0 THEN min(id) OVER (PARTITION BY key, b) ELSE min(id) OVER (PARTITION BY key, b, r) END AS parent FROM ids)"""
_SIGN = "(NOT regexp_matches(label, '[A-Za-z0-9_]') AND label NOT IN ('(', ')', '[', ']', '{', '}'))"

ORACLE_SQL: dict[str, str] = {
    "event_top_down": f"""WITH {_SIDES} SELECT key, unnest(range(0, 2 + 3 * n))::INT AS src_id, unnest(range(0, 2 + 3 * n))::INT AS dst_id FROM sizes WHERE whole
        UNION ALL SELECT key, unnest([3 * x - 1, 3 * x, 3 * x + 1])::INT, unnest([3 * y - 1, 3 * y, 3 * y + 1])::INT FROM equal WHERE NOT whole""",
    "event_common": f"""WITH {_SIDES}, c AS (SELECT key, 0 AS x, 0 AS y, CASE WHEN whole THEN 1 + 3 * n ELSE 0 END + CASE WHEN whole THEN 0 ELSE 3 * k END AS common, 2 + 3 * n AS p, 2 + 3 * m AS q
                FROM (SELECT s.*, (SELECT count(*) FROM equal e WHERE e.key = s.key) AS k FROM sizes s)
            UNION ALL SELECT key, 1, 1, 3 * k, 1 + 3 * n, 1 + 3 * m FROM (SELECT s.*, (SELECT count(*) FROM equal e WHERE e.key = s.key) AS k FROM sizes s)
            UNION ALL SELECT key, 3 * x - 1, 3 * y - 1, 2, 3, 3 FROM equal)
        SELECT key, x::INT AS src_id, y::INT AS dst_id, common, 2.0::DOUBLE * common / (p + q - 2) AS dice, common::DOUBLE / (greatest(p, q) - 1) AS overlap FROM c WHERE common > 0""",
    "event_mapped_hosts": f"""WITH {_SIDES}, nodes AS (SELECT key, 0 AS id, NULL AS parent, NULL AS x FROM sizes UNION ALL SELECT key, 1, 0, NULL FROM sizes
            UNION ALL SELECT key, unnest([3 * i - 1, 3 * i, 3 * i + 1]), unnest([1, 3 * i - 1, 3 * i - 1]), unnest([NULL, i, i]) FROM l)
        SELECT n.key, id::INT AS node_id, CASE WHEN whole THEN parent WHEN e.x IS NOT NULL THEN 3 * e.x - 1 END::INT AS host, CASE WHEN whole THEN parent WHEN e.x IS NOT NULL THEN 3 * e.y - 1 END::INT AS partner
        FROM nodes n JOIN sizes s ON s.key = n.key LEFT JOIN (SELECT key, x, y FROM equal) e ON e.key = n.key AND e.x = n.x""",
    "event_votes": f"""WITH {_SIDES} SELECT key, 0::INT AS src_id, 0::INT AS dst_id, 1::BIGINT AS votes FROM sizes WHERE whole
        UNION ALL SELECT key, 1, 1, count(*) FROM equal GROUP BY key UNION ALL SELECT key, 3 * x - 1, 3 * y - 1, 2 FROM equal""",
    "event_key_leaves": f"""WITH {_SIDES} SELECT l.key, (3 * l.i)::INT AS src_id, (3 * r.i)::INT AS dst_id FROM l JOIN r ON r.key = l.key AND r.name = l.name JOIN sizes s ON s.key = l.key WHERE NOT whole AND l.value != r.value""",
    "event_match": f"""WITH {_SIDES}, s AS (SELECT *, (SELECT count(*) FROM equal e WHERE e.key = sizes.key) AS k FROM sizes),
        t AS (SELECT *, NOT whole AND k > 0 AND (6.0 * k / (3 * n + 3 * m) >= 0.5 OR k::DOUBLE / greatest(n, m) >= 1 / (1 + ln(3 * n + 3 * m))) AS held FROM s),
        changed AS (SELECT l.key, l.i AS x, r.i AS y FROM l JOIN r ON r.key = l.key AND r.name = l.name JOIN t ON t.key = l.key WHERE held AND l.value != r.value),
        kept AS (SELECT key, x, y FROM equal UNION ALL SELECT key, x, y FROM changed)
        SELECT key, 0::INT AS src_id, 0::INT AS dst_id FROM t UNION ALL SELECT key, 1, 1 FROM t WHERE whole OR k > 0
        UNION ALL SELECT key, unnest([3 * x - 1, 3 * x])::INT, unnest([3 * y - 1, 3 * y])::INT FROM kept""",
    "word_nodes": f"""WITH {_WORDS} SELECT key, id::INT AS node_id, parent::INT AS parent_id, CASE WHEN b < 0 THEN -1 WHEN r < 0 THEN b WHEN c < 0 THEN r % 4 ELSE c END::INT AS child_index, size::INT AS pre_size,
            CASE WHEN b < 0 THEN 'document' WHEN r < 0 THEN 'block' WHEN c < 0 THEN 'line' WHEN regexp_matches(label, '[A-Za-z0-9_]') THEN 'word' ELSE label END AS type, label,
            CASE WHEN b < 0 THEN 0 WHEN r < 0 THEN b * 4 ELSE r END::INT AS start_row, CASE WHEN b < 0 THEN last_of_all WHEN r < 0 THEN last_of_block ELSE r END::INT AS end_row FROM sized""",
    "planted_moves": f"""WITH {_WORDS}, moves AS (SELECT m.key, m.id AS seq, CASE WHEN m.r % 4 != 0 THEN m.b ELSE -1 END AS p, CASE WHEN (m.r - 1) % 4 != 0 THEN (m.r - 1) // 4 ELSE -1 END AS q, {_SIGN.replace("label", "m.label")} AS sign
            FROM sized m JOIN sized d ON d.key = m.key AND d.r = m.r - 1 AND d.c = 0 WHERE m.c % 2 = 1 AND m.r % 3 = 1),
        groups AS (SELECT key, p, q, row_number() OVER (PARTITION BY key ORDER BY min(seq)) AS g FROM moves GROUP BY key, p, q HAVING count(*) FILTER (NOT sign) > 1)
        SELECT key, seq, 'group-' || g AS group_id FROM moves JOIN groups USING (key, p, q) WHERE NOT sign""",
    "planted_deletes": f"""WITH {_WORDS}, lines AS (SELECT key, b, r, id, size - 1 AS n, r % 5 != 4 OR size = 1 AS whole FROM sized WHERE r >= 0 AND c < 0),
        blocks AS (SELECT key, b, bool_and(whole) AS whole, count(*) AS n, max(CASE WHEN NOT whole AND n > 1 THEN 1 ELSE 0 END) AS told FROM lines GROUP BY key, b)
        SELECT s.key, s.id::INT AS node_id, k.whole AS subtree FROM sized s JOIN blocks k ON k.key = s.key AND k.b = s.b WHERE s.b >= 0 AND s.r < 0 AND NOT (NOT k.whole AND k.n = 1 AND told = 1)
        UNION ALL SELECT l.key, l.id::INT, true FROM lines l JOIN blocks k ON k.key = l.key AND k.b = l.b WHERE l.whole AND l.n > 0 AND NOT k.whole
        UNION ALL SELECT s.key, s.id::INT, false FROM sized s JOIN lines l ON l.key = s.key AND l.r = s.r WHERE s.c % 2 = 1 AND NOT l.whole""",
}
