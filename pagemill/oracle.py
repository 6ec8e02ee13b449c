"""SQL that recomputes the registered queries from the given tables.

Written from the rules and not from the Spark plans: near-duplicates come from
candidate pairs, positions from one global ``row_number``, bands from
comma-joined values.
"""

from __future__ import annotations

import json
import re
from string import Formatter

from pagemill import fixed_values as fixed
from pagemill import fixtures
from pagemill.functions.text import UNSPACED, WHITESPACE

GAP = "chr(10) || chr(10)"
SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def u32(salt: str, key: str = "seq") -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT)"


def u(salt: str, key: str = "seq") -> str:
    return f"({u32(salt, key)} / 4294967296.0)"


def pick(values: list, salt: str) -> str:
    items = ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST(floor({u(salt)} * {len(values)}) AS INT) + 1]"


def fill(template: str, **fields: str) -> str:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(lit(text))
        if name is not None:
            parts.append(f"coalesce(CAST({fields[name]} AS VARCHAR), 'None')")
    return " || ".join(parts)


def request_prompt(category: str) -> str:
    template, words = {
        "WI_all": (fixed.WI_ALL_PROMPT, fixed.WI_WORDS),
        "WI_part": (fixed.WI_PART_PROMPT, fixed.WI_WORDS),
        "WR_all": (fixed.WR_ALL_PROMPT, fixed.WR_WORDS),
        "WR_part": (fixed.WR_PART_PROMPT, fixed.WR_WORDS),
    }[category]
    return fill(
        template,
        web="webpage",
        author="author",
        word=pick(words, "word"),
        len_limit=pick(fixed.LEN_LIMITS, "len_limit"),
    )


def rest(text: str) -> str:
    return f"array_to_string(string_split({text}, {GAP})[2:], {GAP})"


def cleaned(text: str) -> str:
    return (
        f"trim(CASE WHEN starts_with({text}, 'Here is') OR starts_with({text}, 'Here''s') "
        f"THEN {rest(text)} ELSE {text} END, '\"')"
    )


def section(n_kept: str) -> str:
    return (
        f"CASE WHEN n = 1 THEN webpage ELSE array_to_string("
        f"[trim(ltrim(x, '#'), {SPACE}) FOR x IN parts[1:CAST({n_kept} AS BIGINT)]], {GAP}) END"
    )


UNIFORM = f"(CASE WHEN {u('section_coin')} > 0.5 THEN floor({u('section_n')} * n) + 1 ELSE n END)"
NORMAL = f"(sqrt(-2.0 * ln(1.0 - {u('section_normal_radius')})) * cos(2.0 * pi() * {u('section_normal_angle')}))"
GAUSSIAN = f"round_even(greatest(1.0, least(CAST(n AS DOUBLE), (n // 2) + (n // 4) * {NORMAL})), 0)"
AUTHOR_PROMPT = fill(fixed.AUTHOR_PROMPT, web="webpage")
WI_PROMPT = fill(fixed.WI_RESPONSE_PROMPT, web="webpage", request="request")
REFINE_PROMPT = fill(fixed.WR_REFINE_PROMPT, web="webpage", request="request", answer="response")
USABLE = (
    "coalesce(request, '') <> '' AND coalesce(response, '') <> '' "
    "AND NOT starts_with(response, 'I''m sorry') AND NOT starts_with(response, 'I apologize')"
)
WI_FIRST = f"CASE WHEN {u('side')} > 0.5 THEN request || {GAP} || webpage ELSE webpage || {GAP} || request END"
WR_SECOND = (
    f"CASE WHEN contains(lower(response), 'improved answer') "
    f"THEN trim(trim(trim({rest('response')}, '-'), chr(10)), {SPACE}) ELSE response END"
)
WORDS = "rtrim(regexp_replace(md5(p), '(....)', '\\1 ', 'g'))"


def stub(prompt_table: str, carry: str) -> str:
    """Replies to column ``p``; with failures left out."""
    return f"""SELECT {carry}, CASE left(md5(p), 1)
        WHEN '0' THEN 'I''m sorry, ' || {WORDS}
        WHEN '1' THEN 'Here is the reply:' || {GAP} || {WORDS}
        WHEN '2' THEN '"' || {WORDS} || '"'
        WHEN '3' THEN 'Here''s the Improved Answer:' || {GAP} || '---' || chr(10) || {WORDS} || {GAP} || '---'
        WHEN '4' THEN 'Here''s ' || {WORDS}
        WHEN '5' THEN 'The improved answer:' || {GAP} || '---' || chr(10) || {WORDS} || {GAP} || '---'
        ELSE {WORDS} END AS reply, p FROM {prompt_table}"""


def category(position: str, n: str) -> str:
    return (
        f"CASE WHEN {position} < {n} // 6 * 2 THEN 'WI_all' WHEN {position} < {n} // 6 * 4 THEN 'WI_part' "
        f"WHEN {position} < {n} // 6 * 5 THEN 'WR_all' ELSE 'WR_part' END"
    )


# Characters of scripts without spaces are set apart by blanks first.
ALONE = "([" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in UNSPACED) + "])"
SPACES = "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE)
RUNS = f"[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_{SPACES}]+"


def tokens(text: str) -> str:
    """Distinct tokens of a text."""
    return (
        f"list_distinct(list_append(regexp_extract_all(regexp_replace({text}, '{ALONE}', ' \\1 ', 'g'), '{RUNS}'), "
        f"'{fixed.BEGIN_OF_TEXT}'))"
    )


def near_dup(prefix: str, source: str) -> dict[str, str]:
    """Kept rows of ``source (pool, seq, request, ...)`` by candidate pairs."""
    return {
        f"{prefix}tokens": f"SELECT pool, seq, unnest({tokens('request')}) AS token FROM {source}",
        f"{prefix}hashes": f"""SELECT pool, seq, token, g2 * g2 % 2147483647 * g % 2147483647 AS h
            FROM (SELECT *, g * g % 2147483647 AS g2 FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT),
                list_transform(regexp_extract_all(hex(encode(token)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                lambda x, y: (x * 911382323 + y + 1) % 2147483647) AS g FROM {prefix}tokens))""",
        f"{prefix}sig": f"""SELECT pool, seq, k, min((a * h + b) % 2147483647) AS v
            FROM {prefix}hashes, perms GROUP BY ALL""",
        f"{prefix}bands": f"""SELECT pool, seq, k // 9 AS band, string_agg(v, ',' ORDER BY k) AS key
            FROM {prefix}sig WHERE k < 126 GROUP BY ALL""",
        f"{prefix}pairs": f"""SELECT DISTINCT x.seq AS i, y.seq AS j
            FROM {prefix}bands x JOIN {prefix}bands y USING (pool, band, key)""",
        f"{prefix}removed": f"""SELECT DISTINCT j AS seq FROM {prefix}pairs
            JOIN (SELECT i, min(j) AS m FROM {prefix}pairs GROUP BY i) USING (i) WHERE j > m""",
        f"{prefix}kept": f"SELECT * FROM {source} WHERE seq NOT IN (SELECT seq FROM {prefix}removed)",
    }


def mix(prefix: str, source: str) -> dict[str, str]:
    """Numbered mix of ``source (pool, seq, webpage, ...)``."""
    return {
        f"{prefix}wi": f"""SELECT *, row_number() OVER (ORDER BY {u32('shuffle_wi')}, seq) - 1 AS position
            FROM {source} WHERE pool = 'WI' QUALIFY position < (SELECT n // 3 * 2 FROM base)""",
        f"{prefix}first": f"""SELECT * FROM {source} WHERE pool = 'WR'
            QUALIFY row_number() OVER (PARTITION BY webpage ORDER BY {u32('shuffle_wr')}, seq) = 1""",
        f"{prefix}new": f"""SELECT * FROM {prefix}first
            WHERE webpage NOT IN (SELECT webpage FROM {prefix}wi)""",
        f"{prefix}wr": f"""SELECT *, row_number() OVER (ORDER BY {u32('shuffle_wr')}, seq) - 1 AS position
            FROM {prefix}new QUALIFY position < (SELECT n // 3 FROM base)""",
        f"{prefix}numbered": f"""SELECT *, position AS number FROM {prefix}wi UNION ALL BY NAME
            SELECT *, position + (SELECT count(*) FROM {prefix}wi) AS number FROM {prefix}wr""",
        f"{prefix}final": f"""SELECT number, 'web_data_' || number AS prompt_id, 'user,assistant' AS roles,
            CASE WHEN pool = 'WI' THEN {WI_FIRST} ELSE request END AS first,
            CASE WHEN pool = 'WI' THEN response ELSE {WR_SECOND} END AS second FROM {prefix}numbered""",
    }


CTES: dict[str, str] = {
    "base": "SELECT count(*) * 3 // 10 AS n FROM documents",
    "webpages": fixtures.WEBPAGES.format(documents="documents"),
    "pairs": fixtures.PAIRS.format(documents="documents", webpages="webpages"),
    "turn_pairs": fixtures.TURN_PAIRS.format(conversations="conversations"),
    "scripts": fixtures.SCRIPTS.format(documents="documents"),
    "completions": fixtures.COMPLETIONS.format(webpages="webpages"),
    "buckets": fixtures.BUCKETS.format(documents="documents", bands="unnest([0, 1, 2])"),
    "parts": f"SELECT *, len(parts) AS n FROM (SELECT *, string_split(webpage, {GAP}) AS parts FROM webpages)",
    "routed": f"""SELECT seq, webpage, author, {category('position', 'n')} AS category FROM (
        SELECT *, row_number() OVER (ORDER BY seq) - 1 AS position, count(*) OVER () AS n FROM webpages)""",
    "usable": f"SELECT * FROM pairs WHERE {USABLE}",
    "perms": """SELECT k, CAST('0x' || substr(md5('a:' || k), 1, 8) AS BIGINT) % 2147483646 + 1 AS a,
        CAST('0x' || substr(md5('b:' || k), 1, 8) AS BIGINT) % 2147483647 AS b FROM range(128) r(k)""",
    **near_dup("d_", "usable"),
    **mix("u_", "usable"),
    **mix("k_", "d_kept"),
    "t_rows": f"""SELECT 'turns' AS pool, row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq,
        conv_id, turn, request FROM turn_pairs WHERE {USABLE}""",
    **near_dup("t_", "t_rows"),
    **near_dup("s_", "(SELECT 's' AS pool, seq, text AS request FROM scripts)"),
    "planted": "SELECT DISTINCT x.idx AS i, y.idx AS j FROM buckets x JOIN buckets y USING (band, key)",
    # The stages of a whole run against the stub model.
    "e_author": stub(f"(SELECT seq, webpage, {AUTHOR_PROMPT} AS p FROM webpages)", "seq, webpage"),
    "e_parts": f"""SELECT *, len(parts) AS n FROM (SELECT seq, webpage, reply AS author,
        string_split(webpage, {GAP}) AS parts FROM e_author WHERE left(md5(p), 1) <> 'f')""",
    "e_section": f"SELECT seq, author, {section(UNIFORM)} AS webpage FROM e_parts",
    "e_routed": f"""SELECT seq, webpage, author, {category('position', 'n')} AS category FROM (
        SELECT *, row_number() OVER (ORDER BY seq) - 1 AS position, count(*) OVER () AS n FROM e_section)""",
    "e_ask": "SELECT *, CASE category "
    + " ".join(f"WHEN '{c}' THEN {request_prompt(c)}" for c in fixed.REQUEST_CATEGORIES)
    + " END AS p FROM e_routed",
    "e_asked": stub("e_ask", "seq, category, webpage, author"),
    "e_request": f"""SELECT seq, category, webpage, {cleaned('reply')} AS request
        FROM e_asked WHERE left(md5(p), 1) <> 'f'""",
    "e_answer": stub(
        f"(SELECT *, CASE WHEN starts_with(category, 'WI') THEN {WI_PROMPT} ELSE request END AS p FROM e_request)",
        "seq, category, webpage, request",
    ),
    "e_response": f"""SELECT seq, category, webpage, request, {cleaned('reply')} AS response
        FROM e_answer WHERE left(md5(p), 1) <> 'f'""",
    "e_improve": stub(
        f"(SELECT *, {REFINE_PROMPT} AS p FROM e_response WHERE starts_with(category, 'WR'))",
        "seq, category, webpage, request",
    ),
    "e_refine": f"""SELECT seq, category, webpage, request, {cleaned('reply')} AS response
        FROM e_improve WHERE left(md5(p), 1) <> 'f'""",
    "e_usable": f"""SELECT * FROM (
        SELECT 'WI' AS pool, seq, webpage, request, response FROM e_response WHERE starts_with(category, 'WI')
        UNION ALL SELECT 'WR', seq, webpage, request, response FROM e_refine) WHERE {USABLE}""",
    # The same pages once more, with a model that answers all: first those asked before, under the
    # category that they had then.
    "r_parts": f"""SELECT *, len(parts) AS n FROM (SELECT seq, webpage, reply AS author,
        string_split(webpage, {GAP}) AS parts FROM e_author)""",
    "r_section": f"SELECT seq, author, {section(UNIFORM)} AS webpage FROM r_parts",
    "r_routed": f"""SELECT x.seq, x.webpage, x.author, coalesce(y.category, x.category) AS category FROM (
        SELECT seq, webpage, author, {category('position', 'n')} AS category FROM (
        SELECT *, row_number() OVER (ORDER BY seq) - 1 AS position, count(*) OVER () AS n FROM r_section)) x
        LEFT JOIN (SELECT seq, category FROM e_asked WHERE left(md5(p), 1) <> 'f') y USING (seq)""",
    "r_ask": "SELECT *, CASE category "
    + " ".join(f"WHEN '{c}' THEN {request_prompt(c)}" for c in fixed.REQUEST_CATEGORIES)
    + " END AS p FROM r_routed",
    "r_asked": stub("r_ask", "seq, category, webpage, author"),
    "r_request": f"SELECT seq, category, webpage, {cleaned('reply')} AS request FROM r_asked",
    "r_answer": stub(
        f"(SELECT *, CASE WHEN starts_with(category, 'WI') THEN {WI_PROMPT} ELSE request END AS p FROM r_request)",
        "seq, category, webpage, request",
    ),
    **near_dup("e_d_", "e_usable"),
    **mix("e_k_", "e_d_kept"),
}


def with_ctes(body: str) -> str:
    """Put the CTEs in front that ``body`` needs, directly or not."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\w+", sql)) & CTES.keys() - needed:
            needed.add(name)
            visit(CTES[name])

    visit(body)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


PAGE = "sha256(webpage) AS page"
FINAL = "SELECT prompt_id, roles, first, second FROM"

BODIES: dict[str, str] = {
    "json_array_scan": "SELECT seq, webpage FROM webpages",
    "json_array_split_scan": "SELECT row_number() OVER (ORDER BY seq) - 1 AS place, seq, webpage FROM webpages",
    "json_merge_scan": """SELECT CAST(0 AS INT) AS source_ord, seq AS page_id, webpage FROM pairs WHERE pool = 'WI'
        UNION ALL SELECT 1, min(seq), arg_min(webpage, seq) FROM webpages GROUP BY author
        UNION ALL SELECT 2, seq, webpage FROM pairs WHERE pool = 'WR'""",
    "json_sink_roundtrip": "SELECT * FROM pairs",
    "parquet_sink_roundtrip": f"""SELECT 'row_' || seq AS prompt_id, (SELECT count(*) FROM usable) AS rows_written,
        'user,assistant' AS roles, {WI_FIRST} AS first, response AS second FROM usable""",
    "stage_layout": """SELECT category, count(*) AS pages, min(seq) AS first_seq, max(seq) AS last_seq
        FROM routed GROUP BY category""",
    "prompt_author": f"SELECT seq, {AUTHOR_PROMPT} AS prompt FROM webpages",
    **{
        f"prompt_{c.lower()}": f"SELECT seq, {request_prompt(c)} AS prompt FROM webpages"
        for c in fixed.REQUEST_CATEGORIES
    },
    "prompt_wi_response": f"SELECT seq, {WI_PROMPT} AS prompt FROM pairs",
    "prompt_wr_response": "SELECT seq, request AS prompt FROM pairs",
    "prompt_wr_refine": f"SELECT seq, {REFINE_PROMPT} AS prompt FROM pairs",
    "prompt_dispatch": f"""SELECT 'author' AS stage, '' AS category, seq, {AUTHOR_PROMPT} AS prompt FROM webpages
        UNION ALL SELECT 'request', category, seq, CASE category
        {' '.join(f"WHEN '{c}' THEN {request_prompt(c)}" for c in fixed.REQUEST_CATEGORIES)} END FROM routed
        UNION ALL SELECT 'response', CASE WHEN pool = 'WI' THEN 'WI_all' WHEN seq % 2 = 0 THEN 'WR_refine'
        ELSE 'WR_all' END, seq, CASE WHEN pool = 'WI' THEN {WI_PROMPT} WHEN seq % 2 = 0 THEN {REFINE_PROMPT}
        ELSE request END FROM pairs""",
    "chat_messages": f"""SELECT seq, 'system,user' AS roles, 'You are a helpful assistant.' AS first,
        {AUTHOR_PROMPT} AS second FROM webpages""",
    "chat_template": f"SELECT seq, {fill(fixed.LLAMA3_CHAT, prompt='(' + AUTHOR_PROMPT + ')')} AS prompt FROM webpages",
    "stage_projection": """SELECT p.seq, p.webpage, w.author, p.request, p.response
        FROM pairs p JOIN webpages w USING (seq)""",
    "filter_special_pattern": "SELECT * FROM usable",
    "filter_special_pattern_turns": f"SELECT * FROM turn_pairs WHERE {USABLE}",
    "filter_report": f"""SELECT pool, count(*) AS total,
        count(*) - count(*) FILTER (WHERE {USABLE}) AS deleted FROM pairs GROUP BY pool""",
    "route_category": "SELECT seq, category FROM routed",
    "generate_stub": f"""SELECT seq, reply AS completion, CAST(1 AS INT) AS attempts, sha256(p) AS prompt_hash FROM (
        {stub(f"(SELECT seq, {AUTHOR_PROMPT} AS p FROM webpages)", "seq")})""",
    "completion_success": "SELECT seq, reply AS completion FROM e_author WHERE left(md5(p), 1) <> 'f'",
    "completion_failures": """SELECT seq, CAST(5 AS INT) AS attempts, sha256(p) AS prompt_hash
        FROM e_author WHERE left(md5(p), 1) = 'f'""",
    "generate_options": f"""SELECT seq, reply || ' ' || {lit(json.dumps(fixed.BATCH_MODEL_OPTIONS, sort_keys=True))}
        AS completion, CAST(1 AS INT) AS attempts FROM e_author""",
    "attach_completions": """SELECT r.seq, stage, r.category, r.webpage, r.author, c.completion
        FROM (SELECT *, unnest(['request', 'response']) AS stage FROM routed) r
        LEFT JOIN completions c USING (seq, stage, category)""",
    "resume_pending": """SELECT seq, stage, category, webpage, author
        FROM (SELECT *, unnest(['request', 'response']) AS stage FROM routed) ANTI JOIN completions USING (seq, stage, category)""",
    "stage_counts": """SELECT category, count(*) AS pages,
        count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM completions c WHERE c.seq = routed.seq
            AND c.stage = 'request' AND c.category = routed.category)) AS queued FROM routed GROUP BY category""",
    "section_uniform": f"SELECT seq, {section(UNIFORM)} AS webpage FROM parts",
    "section_gaussian": f"SELECT seq, {section(GAUSSIAN)} AS webpage FROM parts",
    "clean_completion": f"SELECT seq, {cleaned('response')} AS response FROM pairs",
    "keyed_choice": f"""SELECT seq, {pick(fixed.WI_WORDS, 'word')} AS wi_word, {pick(fixed.WR_WORDS, 'word')} AS wr_word,
        CAST({pick(fixed.LEN_LIMITS, 'len_limit')} AS BIGINT) AS len_limit FROM webpages""",
    "minhash_tokens": "SELECT seq, string_agg(token, ' ' ORDER BY token) AS tokens FROM d_tokens GROUP BY seq",
    "minhash_tokens_of_scripts": """SELECT seq, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY token) AS tokens
        FROM s_tokens GROUP BY seq""",
    "minhash_signature_of_scripts": "SELECT seq, string_agg(v, ',' ORDER BY k) AS signature FROM s_sig GROUP BY seq",
    "minhash_signature": "SELECT seq, string_agg(v, ',' ORDER BY k) AS signature FROM d_sig GROUP BY seq",
    "minhash_signature_of_tokens": "SELECT seq, string_agg(v, ',' ORDER BY k) AS signature FROM d_sig GROUP BY seq",
    "minhash_signature_in_sql": "SELECT seq, string_agg(v, ',' ORDER BY k) AS signature FROM d_sig GROUP BY seq",
    "lsh_buckets": "SELECT pool, seq AS idx, CAST(band AS INT) AS band, key FROM d_bands",
    "lsh_candidates": """SELECT x.seq, least(x.seq, min(y.seq)) AS first_candidate, count(DISTINCT x.band) AS shared
        FROM d_bands x JOIN d_bands y ON x.pool = y.pool AND x.band = y.band AND x.key = y.key AND x.seq <> y.seq
        GROUP BY x.seq""",
    "lsh_index_insertions": """SELECT x.seq, least(x.seq, min(y.seq)) AS first_candidate, count(DISTINCT x.band) AS shared
        FROM d_bands x JOIN d_bands y ON x.pool = y.pool AND x.band = y.band AND x.key = y.key AND x.seq <> y.seq
        GROUP BY x.seq""",
    "lsh_candidates_planted": """SELECT x.idx, least(x.idx, min(y.idx)) AS first_candidate, count(DISTINCT x.band) AS shared
        FROM buckets x JOIN buckets y ON x.band = y.band AND x.key = y.key AND x.idx <> y.idx GROUP BY x.idx""",
    "near_dup_removed": "SELECT seq FROM d_removed",
    "near_dup_two_hop": """SELECT DISTINCT j AS idx FROM planted
        JOIN (SELECT i, min(j) AS m FROM planted GROUP BY i) USING (i) WHERE j > m""",
    "near_dup_keep": "SELECT pool, seq FROM d_kept",
    "near_dup_keep_rows": "SELECT * FROM d_kept",
    "near_dup_keep_turns": "SELECT pool, seq, conv_id, turn FROM t_kept",
    "dedup_report": """SELECT pool, count(*) - count(*) FILTER (WHERE kept) AS deleted,
        round(count(*) FILTER (WHERE kept) / count(*) * 100, 2) AS remain_percent
        FROM (SELECT pool, seq NOT IN (SELECT seq FROM d_removed) AS kept FROM usable) GROUP BY pool""",
    "global_row_number": "SELECT pool, seq, row_number() OVER (ORDER BY pool, seq) - 1 AS position FROM pairs",
    "quota_sample": "SELECT seq, position FROM u_wi",
    "wi_pages_distinct": f"SELECT DISTINCT {PAGE} FROM u_wi",
    "first_per_page": f"SELECT {PAGE}, seq FROM u_first",
    "wr_page_anti": "SELECT seq FROM u_new",
    "wr_select": "SELECT seq, position FROM k_wr",
    "pool_union": """SELECT row_number() OVER (ORDER BY source_ord, seq) - 1 AS position, source_ord, seq, category
        FROM (SELECT seq, category, CAST(CASE category WHEN 'WI_part' THEN 0 WHEN 'WI_all' THEN 1
        WHEN 'WR_all' THEN 2 ELSE 3 END AS INT) AS source_ord FROM routed)""",
    "assemble_wi": f"""SELECT seq, 'user,assistant' AS roles, {WI_FIRST} AS first, response AS second
        FROM usable WHERE pool = 'WI'""",
    "assemble_wr": f"""SELECT seq, 'user,assistant' AS roles, request AS first, {WR_SECOND} AS second
        FROM usable WHERE pool = 'WR'""",
    "prompt_ids": "SELECT pool, seq, 'web_data_' || number AS prompt_id FROM u_numbered",
    "final_cap": f"{FINAL} u_final WHERE number < (SELECT n - 20 FROM base)",
    "final_dataset": f"{FINAL} k_final",
    "synthesis_end_to_end": f"{FINAL} e_k_final",
    "synthesis_resume": f"SELECT seq, category, webpage, request, {cleaned('reply')} AS response FROM r_answer",
}

ORACLE: dict[str, str] = {name: with_ctes(body) for name, body in BODIES.items()}
