"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LINES = """lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
_PAIRS = f"""{_LINES}, units AS (
        SELECT DISTINCT 'line' AS kind, line AS part, doc_id FROM lines
        UNION ALL SELECT 'text', text, doc_id FROM documents WHERE text != ''),
    groups AS (SELECT kind, part, count(*) AS n, min(doc_id) AS low FROM units GROUP BY kind, part HAVING count(*) > 1),
    held AS (SELECT u.kind, u.part, n, low, doc_id FROM units u JOIN groups g ON g.kind = u.kind AND g.part = u.part),
    pairs AS (SELECT DISTINCT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON y.kind = x.kind AND y.part = x.part WHERE x.kind = 'line' AND x.n <= 20 AND x.doc_id < y.doc_id
        UNION ALL SELECT low, doc_id FROM held WHERE (kind = 'text' OR n > 20) AND low < doc_id))"""
_EVENTS = """e AS (SELECT lag(event_id) OVER w AS a, event_id AS b, lag(props) OVER w AS src, props AS dst
    FROM (SELECT event_id, user_id, ts, CASE event_id % 5 WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"m": "x", ' || substring(props, 2) WHEN 3 THEN '{}' ELSE props END AS props FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_PROPS = """p AS (SELECT event_id AS key, CASE event_id % 5 WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"m": "x", ' || substring(props, 2) WHEN 3 THEN '{}' ELSE props END AS props FROM events),
    m AS (SELECT key, props, len(json_keys(props)) AS n FROM p),
    k AS (SELECT key, unnest(json_keys(props)) AS name, generate_subscripts(json_keys(props), 1) AS i, props, n FROM m WHERE n > 0),
    v AS (SELECT key, i, n, '"' || name || '"' AS name, (props -> ('$."' || name || '"'))::VARCHAR AS value FROM k),
    nodes AS (SELECT key, 0 AS node_id, -1 AS parent_id, -1 AS child_index, 0 AS depth, CASE WHEN n > 0 THEN 4 ELSE 2 END AS height, 2 + 3 * n AS pre_size, 0 AS post_start, 'document' AS type, '' AS label FROM m
        UNION ALL SELECT key, 1, 0, 0, 1, CASE WHEN n > 0 THEN 3 ELSE 1 END, 1 + 3 * n, 0, 'object', '' FROM m
        UNION ALL SELECT key, 3 * i - 1, 1, i - 1, 2, 2, 3, 3 * i - 3, 'pair', '' FROM v
        UNION ALL SELECT key, 3 * i, 3 * i - 1, 0, 3, 1, 1, 3 * i - 3, 'key', name FROM v
        UNION ALL SELECT key, 3 * i + 1, 3 * i - 1, 1, 3, 1, 1, 3 * i - 2, CASE WHEN value = 'null' THEN 'null' WHEN value[1] = '"' THEN 'string' ELSE 'number' END, value FROM v)"""
_KEYS = """o AS (SELECT a, b, unnest(json_keys(src)) AS key, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
    d AS (SELECT a, b, unnest(json_keys(dst)) AS key, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
    changes AS (SELECT coalesce(o.a, d.a) AS a, coalesce(o.b, d.b) AS event_id, coalesce(o.key, d.key) AS key,
        CASE WHEN o.key IS NULL THEN 'insert' WHEN d.key IS NULL THEN 'delete' ELSE 'update' END AS action,
        o.src ->> ('$."' || o.key || '"') AS old_value, d.dst ->> ('$."' || d.key || '"') AS new_value
        FROM o FULL JOIN d ON o.b = d.b AND o.key = d.key
        WHERE o.key IS NULL OR d.key IS NULL OR (o.src ->> ('$."' || o.key || '"')) IS DISTINCT FROM (d.dst ->> ('$."' || d.key || '"')))"""
_MARKED = f"{_LINES}, marked AS (SELECT doc_id, line_no, contains(line, ' the ') AS changed FROM lines)"
_TURNS = """turns AS (
    SELECT conv_id, row_number() OVER w AS pos, text AS b, lag(text) OVER w AS a FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"""

_PLANTED = """planted AS (SELECT doc_id, CASE doc_id % 8
        WHEN 1 THEN 'total 10' || chr(10) || chr(0) || text WHEN 2 THEN '<<<<<<< ours' || chr(10) || text || chr(10) || '>>>>>>> theirs' || chr(10)
        WHEN 3 THEN text || chr(10) || '<<<<<<< ours' WHEN 4 THEN repeat('0p@P ', 1600) || chr(0) || text
        WHEN 5 THEN repeat('0p@P ', 1599) || 'four' || chr(0) || text WHEN 6 THEN text || repeat('x', 409600) ELSE text END AS text
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""
_CONFLICT = "((starts_with({0}, '<<<<<<<') OR contains({0}, chr(10) || '<<<<<<<')) AND (contains({0}, chr(10) || '>>>>>>>') OR contains({0}, '>>>>>>>' || chr(10))))"

_STATUS = """made AS (SELECT doc_id, ([' M', 'R ', '??', 'MM', 'A ', ' R', 'C ', '!!', 'UU', 'D '])[doc_id % 10 + 1] AS status, doc_id % 10 IN (1, 5, 6) AS moved,
        'src/' || regexp_replace(coalesce(text, ''), '[\\r\\n\\t"]', '_', 'g') || '.' || coalesce(lang, 'x') AS path, doc_id % 3 = 0 AS quoted FROM documents WHERE doc_id % 17 != 0),
    files AS (SELECT doc_id, CASE WHEN moved AND left(status, 1) NOT IN ('R', 'C') THEN 'old.py -> ' || CASE WHEN quoted THEN '"' ELSE '' END || path ELSE path END AS path,
        CASE WHEN moved AND left(status, 1) IN ('R', 'C') THEN 'old.py' END AS old_path, status, left(status, 1) NOT IN (' ', '?', '!') AS staged, right(status, 1) != ' ' AS unstaged FROM made)"""
#: Letters beyond ASCII in the turns as one byte each, as levenshtein counts bytes.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = "translate({}, '" + _WIDE + "', " + " || ".join(f"chr({k})" for k in (*range(1, 9), 11, 12, *range(14, 25))) + ")"


def _bigrams(a: str, b: str, kept: str = "{}") -> str:
    """Dice coefficient of the byte bigrams of two columns; ``kept`` is what they are taken from."""
    grams = "SELECT conv_id, pos, substring(h, i, 4) AS g, count(*) AS n FROM (SELECT conv_id, pos, hex(encode({0})) AS h, unnest(generate_series(1, strlen({0}) * 2 - 3, 2)) AS i FROM kept) GROUP BY ALL"
    return f"""WITH {_TURNS}, cut AS (SELECT conv_id, pos, {a} AS a, {b} AS b FROM turns WHERE a IS NOT NULL AND b IS NOT NULL),
        kept AS (SELECT *, {kept.format("a")} AS p, {kept.format("b")} AS q FROM cut), ga AS ({grams.format("p")}), gb AS ({grams.format("q")}),
        s AS (SELECT conv_id, pos, sum(least(ga.n, gb.n)) AS shared FROM ga JOIN gb USING (conv_id, pos, g) GROUP BY ALL)
        SELECT conv_id, pos, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN strlen(p) < 2 OR strlen(q) < 2 THEN 0.0::DOUBLE
            ELSE 2.0::DOUBLE * coalesce(shared, 0) / (strlen(p) + strlen(q) - 2) END, 6) AS similarity FROM kept LEFT JOIN s USING (conv_id, pos)"""


ORACLE_SQL: dict[str, str] = {
    "doc_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines",
    "line_offsets": f"""WITH {_LINES} SELECT doc_id, line_no,
        CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte,
        strlen(line) AS n_bytes FROM lines""",
    "line_frequency": f"WITH {_LINES} SELECT doc_id, line, count(*) AS n FROM lines GROUP BY doc_id, line",
    "near_copy_pairs": f"WITH {_PAIRS} SELECT a, b FROM pairs",
    "line_dice": f"""WITH {_PAIRS}, freq AS (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY doc_id, line),
        size AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
        SELECT a, b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared, any_value(p.n) AS lines_a, any_value(q.n) AS lines_b,
               round(2.0::DOUBLE * sum(least(x.n, y.n)) / (any_value(p.n) + any_value(q.n)), 6) AS dice
        FROM pairs JOIN freq x ON x.doc_id = a JOIN freq y ON y.doc_id = b AND y.line = x.line
        JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b GROUP BY a, b""",
    "unique_anchors": f"""WITH {_PAIRS}, once AS (SELECT doc_id, line, min(line_no) AS at FROM lines GROUP BY doc_id, line HAVING count(*) = 1)
        SELECT a, b, x.at AS a_row, y.at AS b_row FROM pairs JOIN once x ON x.doc_id = a JOIN once y ON y.doc_id = b AND y.line = x.line""",
    "common_ends": f"""WITH {_PAIRS}, size AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
        m AS (SELECT a, b, p.n AS na, q.n AS nb, least(p.n, q.n) AS least_n FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b),
        front AS (SELECT m.a, m.b, min(x.line_no) AS at FROM m JOIN lines x ON x.doc_id = m.a JOIN lines y ON y.doc_id = m.b AND y.line_no = x.line_no WHERE x.line != y.line GROUP BY m.a, m.b),
        back AS (SELECT m.a, m.b, min(m.na - 1 - x.line_no) AS at FROM m JOIN lines x ON x.doc_id = m.a JOIN lines y ON y.doc_id = m.b AND m.nb - y.line_no = m.na - x.line_no WHERE x.line != y.line GROUP BY m.a, m.b)
        SELECT m.a, m.b, coalesce(front.at, least_n) AS prefix, least(coalesce(back.at, least_n), least_n - coalesce(front.at, least_n)) AS suffix
        FROM m LEFT JOIN front USING (a, b) LEFT JOIN back USING (a, b)""",
    "gate_modes": f"""WITH {_PLANTED} SELECT doc_id, CASE WHEN {_CONFLICT.format("text")} THEN 'conflict' WHEN strlen(text) > 409600 THEN 'size'
            WHEN contains(text, chr(0)) AND strlen(split_part(text, chr(0), 1)) < 8000 THEN 'binary' ELSE 'none' END AS gate, strlen(text) AS n_bytes FROM planted""",
    "pair_gates": f"""WITH {_PLANTED}, p AS (SELECT doc_id, d.text AS src, q.text AS dst, doc_id % 2 = 0 AS py, doc_id % 3 = 0 AS js FROM documents d JOIN planted q USING (doc_id))
        SELECT doc_id AS pair_id, CASE WHEN doc_id % 11 = 0 OR {_CONFLICT.format("coalesce(src, '')")} OR {_CONFLICT.format("dst")} THEN 'conflict'
                WHEN strlen(coalesce(src, '')) > 409600 OR strlen(dst) > 409600 THEN 'size' WHEN NOT py AND NOT js THEN 'language' ELSE 'tree' END AS mode,
            CASE WHEN py THEN 'python' WHEN js THEN 'json' END AS lang, CASE WHEN js THEN 'json' WHEN py THEN 'python' END AS dst_lang FROM p""",
    "page_language": """SELECT page_id, CASE WHEN e IN ('html', 'htm') THEN 'html' WHEN e IN ('json', 'css', 'js') THEN e ELSE 'unknown' END AS lang
        FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""",
    "trivial_lines": f"""WITH {_LINES}, t AS (SELECT doc_id, CASE WHEN line_no % 3 = 1 THEN (['{{', '}}', '(', ')', '[', ']', '}};', ');', '}})', '}});', '()', '{{}}', '() {{',
                '*', '/**', '/*', '*/', '//', '<p>', '</p>', '', '],', '}} else {{', 'x'])[length(line) % 24 + 1] ELSE trim(line, ' ' || chr(9) || chr(13) || chr(160)) END AS line FROM lines)
        SELECT doc_id, count(*) FILTER (line IN ('{{', '}}', '(', ')', '[', ']', '}};', ');', '}})', '}});', '()', '{{}}', '() {{')) AS n_trivial,
               count(*) FILTER (line IN ('*', '/**', '/*', '*/', '//', '<p>', '</p>')) AS n_anchor,
               count(*) FILTER (regexp_matches(line, '[A-Za-z0-9_]')) AS n_word, count(*) AS n_lines FROM t GROUP BY doc_id""",
    "bigram_similarity": _bigrams("trim(a, ' ' || chr(9) || chr(10) || chr(13))", "trim(b, ' ' || chr(9) || chr(10) || chr(13))"),
    "comment_similarity": _bigrams(*(f"trim(lower({c}), '/#* ' || chr(9) || chr(10) || chr(13))" for c in ("'// ' || a", "'/* ' || b || ' */'")), "regexp_replace({}, '[^a-z0-9]', '', 'g')"),
    "levenshtein_ratio": f"""WITH {_TURNS}, t AS (SELECT conv_id, pos, {_NARROW.format("a")} AS a, {_NARROW.format("b")} AS b FROM turns WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT conv_id, pos, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0::DOUBLE
            ELSE 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS ratio FROM t""",
    "attribute_values": """SELECT page_id, substring(q, 2, length(q) - 2) AS value, count(*) AS n
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '[a-z-]+=("[^"<>]*"|''[^''<>]*'')', 1)) AS q FROM pages) GROUP BY ALL""",
    "tag_counts": """SELECT page_id, tag, count(*) AS n FROM (
        SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL""",
    "json_pair_diff": f"""WITH {_EVENTS}, {_KEYS} SELECT event_id, key, action, old_value, new_value FROM changes""",
    "folds": f"""WITH {_MARKED}, near AS (SELECT doc_id, line_no, max(changed::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM marked),
        runs AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM near WHERE n = 0)
        SELECT doc_id, min(line_no) AS start_row, max(line_no) AS end_row FROM runs GROUP BY doc_id, i HAVING count(*) > 1""",
    "next_change": f"""WITH {_MARKED}, hit AS (SELECT doc_id, line_no, CASE WHEN changed THEN line_no END AS h FROM marked)
        SELECT doc_id, line_no AS row, coalesce(min(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(h) OVER (PARTITION BY doc_id)) AS next_row,
            coalesce(max(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(h) OVER (PARTITION BY doc_id)) AS previous_row FROM hit""",
    "search_matches": f"""WITH {_LINES}, p AS (SELECT doc_id, line_no, string_split(replace(lower(line), chr(9), '    '), 'tion') AS p FROM lines WHERE contains(lower(line), 'tion')),
        k AS (SELECT doc_id, line_no, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p)
        SELECT doc_id, line_no, strlen(array_to_string(p[1:k], '    ')) AS start_col, strlen(array_to_string(p[1:k], '    ')) + 4 AS end_col FROM k""",
    "git_status": f"""WITH {_STATUS} SELECT doc_id, path, old_path, status, staged, unstaged FROM files""",
    "git_name_status": """WITH p AS (SELECT doc_id AS k, 'src/' || regexp_replace(coalesce(text, ''), '[\\r\\n\\t"]', '_', 'g') || '.' || coalesce(lang, 'x') AS path FROM documents)
        SELECT k AS doc_id, CASE k % 10 WHEN 1 THEN 'R087' WHEN 3 THEN 'C050' ELSE 'M' END AS status, CASE k % 10 WHEN 1 THEN 'new.py' ELSE path END AS path, CASE k % 10 WHEN 1 THEN path END AS old_path FROM p WHERE k % 10 != 2""",
    "git_sections": f"""WITH {_STATUS}, rows AS (SELECT *, 'staged' AS section, substring(status, 1, 1) || ' ' AS shown FROM files WHERE staged
            UNION ALL SELECT *, 'unstaged', CASE WHEN status = '??' THEN '??' ELSE ' ' || substring(status, 2, 1) END FROM files WHERE unstaged),
        c AS (SELECT *, contains(status, 'U') OR status IN ('AA', 'DD') AS conflict FROM rows)
        SELECT doc_id, section, shown, conflict, CASE WHEN conflict OR section = 'staged' THEN 'HEAD' ELSE ':' END AS left_revision, coalesce(old_path, path) AS left_path,
            CASE WHEN NOT conflict AND section = 'staged' THEN ':' ELSE '' END AS right_revision, path AS right_path, section = 'unstaged' AND NOT conflict AS stageable FROM c""",
}

ORACLE_SQL |= {
    "node_tag_counts": ORACLE_SQL["tag_counts"],
    "node_attribute_values": ORACLE_SQL["attribute_values"],
    "json_tree_actions": f"""WITH {_EVENTS}, o AS (SELECT a, b, unnest(json_keys(src)) AS key, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
        d AS (SELECT a, b, unnest(json_keys(dst)) AS key, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
        j AS (SELECT coalesce(o.a, d.a) AS a, coalesce(o.b, d.b) AS b, (o.src -> ('$."' || o.key || '"'))::VARCHAR AS x, (d.dst -> ('$."' || d.key || '"'))::VARCHAR AS y FROM o FULL JOIN d ON o.b = d.b AND o.key = d.key),
        k AS (SELECT *, CASE WHEN x = 'null' THEN 'null' WHEN x[1] = '"' THEN 'string' WHEN x IS NOT NULL THEN 'number' END AS p, CASE WHEN y = 'null' THEN 'null' WHEN y[1] = '"' THEN 'string' WHEN y IS NOT NULL THEN 'number' END AS q FROM j)
        SELECT a, b, 'update' AS action, p AS type, x AS old_value, y AS new_value FROM k WHERE p = q AND x != y
        UNION ALL SELECT a, b, 'delete', p, x, NULL FROM k WHERE p IS NOT NULL AND p IS DISTINCT FROM q
        UNION ALL SELECT a, b, 'insert', q, NULL, y FROM k WHERE q IS NOT NULL AND p IS DISTINCT FROM q""",
    "copy_groups": f"WITH {_PAIRS} SELECT kind, sha256(part) AS key, n, low AS representative, doc_id FROM held",
    "column_layers": f"""WITH {_LINES}, low AS (SELECT doc_id, line_no, replace(lower(line), chr(9), '    ') AS l FROM lines),
        found AS (SELECT doc_id, line_no, w, p, unnest(generate_series(1, len(p) - 1)) AS k FROM (SELECT doc_id, line_no, w, string_split(l, w) AS p FROM low, (VALUES ('the'), ('tion')) t(w) WHERE contains(l, w))),
        spans AS (SELECT doc_id, line_no, list_sum(list_transform(p[1:k], lambda x: strlen(x)))::BIGINT + (k - 1) * strlen(w) AS a, list_sum(list_transform(p[1:k], lambda x: strlen(x)))::BIGINT + k * strlen(w) AS b, strlen(w) AS size,
                CASE WHEN w = 'tion' THEN 'update' WHEN line_no % 2 = 0 THEN 'delete' ELSE 'insert' END AS action FROM found
            UNION ALL SELECT doc_id, line_no, 0, strlen(line), strlen(line), 'move' FROM lines WHERE doc_id % 3 = 0 AND line != ''),
        cells AS (SELECT doc_id, line_no, unnest(generate_series(a, b - 1)) AS c, size, b - a AS n, action, CASE action WHEN 'update' THEN 4 WHEN 'insert' THEN 3 WHEN 'move' THEN 2 ELSE 1 END AS p FROM spans),
        best AS (SELECT doc_id, line_no, c, arg_min(action, (size, n, -p)) AS x, bool_or(action = 'move') AS moved FROM cells GROUP BY ALL),
        shown AS (SELECT doc_id, line_no, c, CASE WHEN x = 'update' AND moved THEN 'move_update' ELSE x END AS action FROM best),
        runs AS (SELECT *, c - row_number() OVER (PARTITION BY doc_id, line_no, action ORDER BY c) AS r FROM shown)
        SELECT doc_id, 'left' AS side, line_no AS line, min(c) AS start_col, max(c) + 1 AS end_col, action FROM runs GROUP BY doc_id, line_no, action, r""",
    "event_nodes": f"WITH {_PROPS} SELECT key, node_id::INT AS node_id, parent_id::INT AS parent_id, child_index::INT AS child_index, depth::INT AS depth, height::INT AS height, pre_size::INT AS pre_size, post_start::INT AS post_start, type, label FROM nodes",
    "event_type_counts": f"""WITH {_PROPS} SELECT key, type, count(*) AS n, count(*) FILTER (pre_size = 1) AS n_leaves, max(depth)::INT AS max_depth, max(height)::INT AS max_height FROM nodes GROUP BY key, type""",
    "event_leaves": f"WITH {_PROPS} SELECT key, type, label, count(*) AS n FROM nodes WHERE pre_size = 1 AND label != '' GROUP BY ALL",
    "event_subtrees": f"WITH {_PROPS} SELECT key, node_id::INT AS node_id, pre_size::BIGINT AS counted FROM nodes WHERE pre_size > 1",
    "event_hosts": f"WITH {_PROPS} SELECT key, node_id::INT AS node_id, CASE WHEN depth = 3 THEN parent_id::INT END AS ancestor_id FROM nodes",
    "event_repeats": f"""WITH {_PROPS}, g AS (SELECT name, value, count(*) AS places, count(DISTINCT key) AS documents FROM v GROUP BY ALL HAVING count(*) > 1)
        SELECT places, documents, 3::INT AS pre_size, 'pair' AS type, count(*) AS n FROM g GROUP BY ALL""",
    "event_label_counts": f"WITH {_PROPS} SELECT key, label, count(*) AS n FROM nodes WHERE label != '' GROUP BY ALL",
    "self_edit_summary": f"""WITH {_LINES}, n AS (SELECT doc_id, any_value(text) AS text, count(*) AS n, count(*) FILTER (line_no % 7 = 6) AS d FROM lines JOIN documents USING (doc_id) GROUP BY doc_id)
        SELECT doc_id AS a, CASE WHEN text = '' THEN 0 ELSE n - d END AS equal_lines, 0::BIGINT AS changed_lines, d AS deleted_lines, CASE WHEN text = '' THEN 1 ELSE 0 END::BIGINT AS inserted_lines FROM n""",
    "self_edit_actions": f"""WITH {_LINES}, n AS (SELECT doc_id, count(*) FILTER (line_no % 7 = 6) AS d, any_value(text) AS text FROM lines JOIN documents USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, unnest(['compat', 'full']) AS mode, CASE WHEN text = '' THEN 'insert' ELSE 'delete' END AS action, greatest(d, (text = '')::BIGINT) AS n, greatest(d, (text = '')::BIGINT) - 1 AS last FROM n WHERE d > 0 OR text = ''""",
    "code_modes": f"""SELECT DISTINCT o_custkey AS pair_id, 'tree' AS mode, (['python', 'javascript', 'typescript', 'tsx', 'go', 'rust', 'java', 'csharp', 'c', 'cpp', 'php', 'zig', 'lua', 'ruby', 'bash', 'css', 'yaml', 'toml'])[o_custkey % 18 + 1] AS lang,
        0::INT AS errors FROM orders""",
    "code_errors": """SELECT DISTINCT o_custkey AS pair_id, CASE WHEN o_custkey % 3 = 0 THEN 'errors' ELSE 'tree' END AS mode, 0::INT AS before, CASE o_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS after
        FROM orders WHERE o_custkey % 18 < 16""",
    "code_updates": """WITH o AS (SELECT o_custkey AS pair_id, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders WHERE o_orderkey % 7 != 0)
        SELECT pair_id, 'tree' AS origin, v::VARCHAR AS old_value, (v + 1)::VARCHAR AS new_value FROM o WHERE k % 3 = 0
        UNION ALL SELECT pair_id, 'comment', 'note ' || k, 'note ' || k || ' b' FROM o WHERE k % 5 = 0 AND pair_id % 18 < 16""",
    "code_comments": """SELECT o_custkey AS pair_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx,
        CASE WHEN o_custkey % 18 IN (16, 17) THEN 'note' WHEN o_custkey % 18 = 12 THEN '-- note ' || o_orderkey ELSE 'note ' || o_orderkey END AS text FROM orders""",
    "code_declarations": """SELECT o_custkey AS pair_id, 'order_' || o_orderkey AS name FROM orders WHERE o_orderkey % 7 != 0 AND o_custkey % 18 NOT IN (16, 17)""",
    "code_keywords": """WITH w AS (SELECT unnest(range(18)) AS k, unnest([['def', 'return'], ['function', 'return'], ['function', 'return'], ['function', 'return'], ['func', 'return'], ['fn', 'return'], ['class'], ['class'],
            ['return'], ['class'], ['function', 'return'], ['fn', 'return'], ['function', 'return', 'end'], ['def', 'return', 'end'], ['function', 'return'], [], [], []]) AS words)
        SELECT o_custkey AS pair_id, word, count(*) AS n FROM orders JOIN (SELECT k, unnest(words) AS word FROM w) ON k = o_custkey % 18 GROUP BY ALL""",
    "code_previews": """SELECT o_custkey AS pair_id, 'UPDATE  ' || chr(39) || v || chr(39) || ' → ' || chr(39) || (v + 1) || chr(39) AS preview
        FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders) WHERE o_orderkey % 7 != 0 AND o_orderkey % 3 = 0""",
    "code_ranges": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT)::VARCHAR AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
        p AS (SELECT *, CASE WHEN c % 18 IN (0, 16, 17) THEN 3 ELSE 4 END AS n, ([11, 9, 9, 9, 8, 11, 10, 10, 9, 10, 9, 11, 9, 9, 9, 9, 9, 8])[c % 18 + 1] AS col FROM o)
        SELECT c AS pair_id, v AS old_value, 'L' || (n * i + 3) || ':' || (col + 1) || ' - L' || (n * i + 3) || ':' || (col + 1 + length(v)) AS range FROM p WHERE k % 7 != 0 AND k % 3 = 0""",
    "code_deletes": """SELECT o_custkey AS pair_id, count(*) AS entries, count(*) AS notes, 0::BIGINT AS others FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey""",
    "code_alignment": """WITH o AS (SELECT o_custkey AS pair_id, CASE WHEN o_custkey % 18 IN (0, 16, 17) THEN 3 ELSE 4 END AS n, count(*) AS l, count(*) FILTER (o_orderkey % 7 != 0) AS r FROM orders GROUP BY ALL)
        SELECT pair_id, l * n + 1 AS left_lines, CASE WHEN r = 0 THEN 0 ELSE r * n + 1 END AS right_lines FROM o""",
    "line_envelope_totals": f"""WITH {_PAIRS}, size AS (SELECT doc_id, count(*) AS n, any_value(text) AS text FROM lines JOIN documents USING (doc_id) GROUP BY doc_id),
        s AS (SELECT a || '-' || b AS pair_id, p.n AS m, q.n AS n FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b)
        SELECT pair_id, 'v1' AS version, m - n AS balance, m AS left_lines, n AS right_lines FROM s""",
    "virtual_lines": f"""WITH {_MARKED}, near AS (SELECT doc_id, line_no, max(changed::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM marked),
        runs AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM near WHERE n = 0),
        folds AS (SELECT doc_id, min(line_no) AS lo, max(line_no) AS hi FROM runs GROUP BY doc_id, i HAVING count(*) > 1),
        seen AS (SELECT m.doc_id, line_no, lo, hi FROM marked m LEFT JOIN folds f ON f.doc_id = m.doc_id AND line_no BETWEEN lo AND hi WHERE lo IS NULL OR line_no = lo)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS virtual_row, CASE WHEN lo IS NULL THEN line_no END AS row, lo AS fold_start, hi AS fold_end FROM seen""",
    "line_tints": f"""WITH {_LINES} SELECT doc_id, line_no AS line, CASE
            WHEN doc_id % 3 = 0 AND strlen(line) < 3 THEN 'move' WHEN contains(lower(line), 'the') THEN CASE WHEN line_no % 2 = 0 THEN 'delete' ELSE 'insert' END
            WHEN contains(lower(line), 'tion') THEN 'update' ELSE 'move' END AS action
        FROM lines WHERE contains(lower(line), 'the') OR contains(lower(line), 'tion') OR doc_id % 3 = 0 AND line != ''""",
    "untouched_blocks": f"""WITH {_PAIRS}, once AS (SELECT doc_id, line, min(line_no) AS at FROM lines GROUP BY doc_id, line HAVING count(*) = 1),
        m AS (SELECT a, b, x.at AS row, y.at AS other FROM pairs JOIN once x ON x.doc_id = a JOIN once y ON y.doc_id = b AND y.line = x.line),
        size AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
        blocks AS (SELECT a, b, n, unnest(generate_series(0, (n - 1) // 3)) AS node_id FROM (SELECT DISTINCT a, b FROM m) JOIN size ON doc_id = a),
        g AS (SELECT q.a, q.b, node_id, node_id * 3 AS start_row, least(node_id * 3 + 3, n) - 1 AS end_row, count(row) AS c, min(other - row) AS lo, max(other - row) AS hi, min(other) AS first
            FROM blocks q LEFT JOIN m ON m.a = q.a AND m.b = q.b AND row BETWEEN node_id * 3 AND least(node_id * 3 + 3, n) - 1 GROUP BY ALL)
        SELECT a, b, node_id, start_row, end_row, CASE WHEN c = end_row - start_row + 1 AND lo = hi THEN first END AS other_row FROM g""",
    "word_overlap": f"""WITH {_TURNS}, t AS (SELECT conv_id, pos, a, b FROM turns WHERE a IS NOT NULL AND b IS NOT NULL),
        x AS (SELECT conv_id, pos, w, count(*) AS n FROM (SELECT conv_id, pos, unnest(string_split(a, ' ')) AS w FROM t) WHERE w != '' GROUP BY ALL),
        y AS (SELECT conv_id, pos, w, count(*) AS n FROM (SELECT conv_id, pos, unnest(string_split(b, ' ')) AS w FROM t) WHERE w != '' GROUP BY ALL),
        j AS (SELECT coalesce(x.conv_id, y.conv_id) AS a, coalesce(x.pos, y.pos) AS b, coalesce(x.w, y.w) AS w, coalesce(x.n, 0) AS p, coalesce(y.n, 0) AS q FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.pos = y.pos AND x.w = y.w)
        SELECT a, b, round(2.0::DOUBLE * sum(least(p, q)) / sum(p + q), 6) AS dice, CAST((SELECT coalesce(sum(q), 0) FROM j k WHERE k.a = j.a AND k.b = j.b AND k.p > 0) AS BIGINT) AS overlap
        FROM j WHERE regexp_matches(w, '[A-Za-z0-9_]') GROUP BY a, b""",
    "readable_texts": """WITH c AS (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS t FROM conversations)
        SELECT conv_id, turn, role, CASE WHEN length(t) <= 12 THEN t ELSE substring(t, 1, 11) || '…' END AS cut, CASE WHEN length(t) >= 40 THEN t ELSE rpad(t, 40, ' ') END AS pad,
            repeat(' ', (41 - least(length(t), 41)) // 2) || substring(t, 1, 41) || repeat(' ', 41 - least(length(t), 41) - (41 - least(length(t), 41)) // 2) AS centre,
            (['function', 'if', 'call', 'type', 'string'])[turn % 5 + 1] AS kind, 'L' || (turn + 1) || ':' || (conv_id % 7 + 1) AS place FROM c""",
    "merged_spans": """WITH p AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents WHERE contains(text, 'the')),
        k AS (SELECT doc_id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p),
        s AS (SELECT doc_id, sum(strlen(p[k])) OVER (PARTITION BY doc_id ORDER BY k) + 3 * (k - 1) AS start_byte FROM k),
        n AS (SELECT doc_id, start_byte, CASE WHEN start_byte <= lag(start_byte) OVER (PARTITION BY doc_id ORDER BY start_byte) + 6 THEN 0 ELSE 1 END AS fresh FROM s),
        r AS (SELECT doc_id, start_byte, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_byte) AS run FROM n)
        SELECT doc_id, CAST(min(start_byte) AS BIGINT) AS start_byte, CAST(max(start_byte) + 3 AS BIGINT) AS end_byte, count(*) AS n FROM r GROUP BY doc_id, run""",
    "span_pieces": f"""WITH o AS ({ORACLE_SQL["line_offsets"]}), p AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents WHERE contains(text, 'the')),
        k AS (SELECT doc_id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p),
        starts AS (SELECT doc_id, (sum(strlen(p[k])) OVER (PARTITION BY doc_id ORDER BY k) + 3 * (k - 1))::BIGINT AS f FROM k),
        s AS (SELECT doc_id, 0 AS f, strlen(text) AS t FROM documents UNION ALL SELECT doc_id, f, lead(f) OVER (PARTITION BY doc_id ORDER BY f) FROM starts)
        SELECT doc_id, f AS start_byte, t AS end_byte, line_no, greatest(f, start_byte) - start_byte AS start_col, least(t, start_byte + n_bytes) - start_byte AS end_col
        FROM o JOIN s USING (doc_id) WHERE t IS NOT NULL AND greatest(f, start_byte) < least(t, start_byte + n_bytes)""",
    "clean_labels": "SELECT conv_id, turn, role, trim(lower(text), '/#* ' || chr(9) || chr(13) || chr(10)) AS clean FROM conversations",
}
