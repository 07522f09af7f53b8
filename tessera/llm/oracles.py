"""DuckDB texts of the operators' queries that SQL can express, over whole tables."""

from __future__ import annotations

from tessera.llm import license_digest, line_rules, phrase_index


def _rules() -> str:
    word, boiler = r"[^\x20\x09-\x0D]+", line_rules.boilerplate_pattern().replace("'", "''")
    n = lambda pattern, text: f"len(regexp_extract_all({text}, '{pattern}'))"
    words, upper, lower = n(word, "x"), n(r"\p{Lu}", "x"), n(r"\p{Ll}", "x")
    marks, signs = n("[!?]{2,}", "x"), n("[#*$%&|<>»›·•]+", "x")
    fails = (
        f"(({upper} > {line_rules.MAX_UPPER_SHARE}::DOUBLE * ({upper} + {lower}) AND {words} >= 3) OR ({marks} >= 3 AND {marks} >= {line_rules.MAX_MARKS_PER_WORD}::DOUBLE * {words})"
        f" OR ({signs} >= 1 AND {signs} >= {line_rules.MAX_SYMBOLS_PER_WORD}::DOUBLE * {words}) OR regexp_matches(x, '{boiler}'))"
    )
    k, m = line_rules.WINDOW, line_rules.MENU_LINES
    # run[j] of the lines around line i, from m - 1 before it on; a menu line stands in m of them in a row
    runs = " OR ".join(" AND ".join(f"coalesce(m[i + {j}], false)" for j in range(low, low + m)) for low in range(1 - m, 1))
    menu = f"list_transform(ls, lambda x: length(x) <= {line_rules.MENU_CHARS} AND regexp_matches(x, '{line_rules.MENU_LINE}'))"
    return f"""
    WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
    r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {k})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p) AS c FROM g) WHERE c > 1) GROUP BY 1),
    e AS (SELECT doc_id, w, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {n("[#*$%&|<>]", "t")} AS n_symbols,
      list_filter(ls, lambda x: regexp_matches(x, '{word}')) AS f, list_filter(ls, lambda x, i: NOT {fails} AND NOT ({runs})) AS ok, coalesce(n, 0) AS n_repeat_words FROM (SELECT *, {menu} AS m FROM d) LEFT JOIN r USING (doc_id)),
    z AS (SELECT *, len(ls) - len(ok) AS n_bad_lines, CASE WHEN len(ls) = len(ok) THEN 0 ELSE n_words - {n(word, "array_to_string(ok, chr(10))")} END AS n_lost_words,
      n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM e)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND n_lost_words < {line_rules.MAX_LOST}::DOUBLE * n_words AS kept,
      CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(n_lost_words AS BIGINT) AS n_lost_words FROM z"""


def _phrases() -> str:
    k = phrase_index.WINDOW_WORDS
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item, w, least(len(w), {k}) AS n, unnest(range(1, greatest(1, len(w) - {k - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT doc_id, {words} AS w FROM documents),
    g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
    h AS (SELECT doc_id, i, n, item FROM g JOIN p USING (n, p)),
    a AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
    s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _warc() -> str:
    digit = lambda at: f"(instr('0123456789abcdef', substr(x, CAST({at} AS INTEGER), 1)) - 1)"
    five = f"((({digit('5 * g // 4 + 1')} * 16 + {digit('5 * g // 4 + 2')}) >> CAST(3 - (5 * g) % 4 AS INTEGER)) & 31)"
    base32 = f"array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({five} AS INTEGER) + 1, 1)), '')"
    return f"""
    SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> last THEN last END AS refers_to
    FROM (SELECT page_id, p, sha1(p) AS x, max(page_id) OVER (PARTITION BY p) AS last FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _rules(), "op4_license_scan": license_digest.oracle_sql(), "op6_warc": _warc(), "op7_benchmark_decontamination": _phrases(),
    }
