"""SQL for those queries of this subpackage that SQL can express.

Written from the contracts, by plain means: all windows, all pairs of texts that share a
shingle. ``doc_id`` is unique in the tables.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(h) >= 400)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
edge AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit),
span AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS b
         FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM edge) GROUP BY ALL),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM span
        UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (q - p) AS BIGINT)), '' ORDER BY p) AS k
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE["op3_decontamination"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
iwin AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS k FROM
         (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, CAST(len(ws) - least(10, len(ws)) + 2 AS BIGINT))) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS k FROM
         (SELECT doc_id, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN iwin USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op5_quality_rules"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
grams AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) - 1 AS BIGINT))) AS i FROM w WHERE len(ws) > 2)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM often) GROUP BY doc_id),
s AS (SELECT doc_id, t, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 3 OR word_chars > n_words * 12
            OR n_dup_lines * 2 > n_lines OR length(regexp_replace(t, '[^A-Z]+', '', 'g')) * 2 > word_chars) AS kept
FROM b
"""

ORACLE["op10_near_dedup"] = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, ws[i:i + 4] AS s FROM (SELECT doc_id, ws, unnest(range(1, CAST(greatest(len(ws) - 4, 1) + 1 AS BIGINT))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id,
       coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id
"""

ORACLE["op2_tool_call_linking"] = """
WITH calls AS (SELECT conv_id, turn, text, 'call-' || conv_id || '-' || turn AS call_id,
                      min(turn) OVER (PARTITION BY conv_id) AS opening FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id, turn - 1 AS turn, text AS result FROM conversations WHERE role = 'assistant')
SELECT conv_id, call_id, turn, CAST(turn > opening AS INTEGER) AS level,
       CASE WHEN text IS NULL THEN 'bad arguments' END AS problem,
       CAST(CASE WHEN result IS NULL
            THEN json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', call_id, 'name', 'reply')
            ELSE json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', call_id, 'name', 'reply', 'result', result)
            END AS VARCHAR) AS record
FROM calls LEFT JOIN answers USING (conv_id, turn)
"""

# All phrases of up to four words are counted, frequent or not.
ORACLE["op12_collocations"] = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, m, ws[i:i + m - 1] AS g FROM
          (SELECT lang, ws, m, unnest(range(1, CAST(len(ws) - m + 2 AS BIGINT))) AS i
           FROM ws, (VALUES (1), (2), (3), (4)) AS lengths(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a FROM f WHERE m > 1 AND f >= 30),
inner_parts AS (SELECT lang, a AS longer, g[i:j] AS g FROM
                (SELECT lang, a, g, m, i, unnest(range(i + 1, m + 1)) AS j FROM
                 (SELECT lang, a, g, m, unnest(range(1, CAST(m AS BIGINT))) AS i FROM c WHERE m > 2)) WHERE j - i + 1 < m),
hidden AS (SELECT DISTINCT c.lang, c.g FROM c JOIN inner_parts p ON p.lang = c.lang AND p.g = c.g WHERE 100 * longer >= 80 * a),
cuts AS (SELECT lang, g, a, m, unnest(range(1, CAST(m AS BIGINT))) AS k FROM c ANTI JOIN hidden USING (lang, g)),
scored AS (SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:cuts.m]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM least
           QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN total USING (lang)
"""
