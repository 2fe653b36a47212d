"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from tonewright.llm.quality import BOILERPLATE, CLOSING, SEPARATORS

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(items) -> str:
    return ", ".join("'" + s.replace("'", "''") + "'" for s in items)


def quality_ctes(source: str) -> str:
    """CTEs up to ``verdict``: one row per row of ``source`` (doc_id, text), keyed by rid."""
    return rf"""
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}
), w AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM d)
), w3 AS (
  SELECT rid, pos, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), rep AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM w3 WHERE c IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid
), l AS (
  SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)
), lw AS (
  SELECT *, regexp_extract_all(line, '{WORD}') AS ws FROM l
), lf AS (
  SELECT rid, ln, line, len(ws) AS k,
    row_number() OVER (PARTITION BY rid, line ORDER BY ln) > 1 AS dup,
    10 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > length(array_to_string(ws, '')) AS symbols,
    length(line) - length(replace(replace(line, '!', ''), '?', '')) > len(ws) AS shouting,
    len(list_filter(ws, lambda x: x IN ({_quoted(SEPARATORS)}))) AS seps,
    substr(ws[len(ws)], length(ws[len(ws)]), 1) AS last,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILERPLATE}') AS boiler
  FROM lw WHERE len(ws) > 0
), lines AS (
  SELECT *, dup OR symbols OR shouting OR (seps >= 2 AND 8 * seps >= k)
    OR (k < 4 AND last NOT IN ({_quoted(CLOSING)})) OR boiler AS fails
  FROM lf
), per AS (
  SELECT rid, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(k) FILTER (fails), 0) AS lost FROM lines GROUP BY rid
), base AS (
  SELECT rid, doc_id, text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS ws FROM d)
), verdict AS (
  SELECT rid, doc_id, text, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM base LEFT JOIN per USING (rid) LEFT JOIN covered USING (rid)
)"""


QUALITY_SQL = f"""
WITH {quality_ctes("documents")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_words <= 30 * n_words AS kept, lost_words::BIGINT AS lost_words
FROM verdict
"""


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), t AS (
  SELECT doc_id, pos, line, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), again AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS nth FROM t WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM again, (VALUES (0), (1), (2)) AS s(k) WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.ln, l.line, w.pos, g.pos IS NOT NULL AS cut
  FROM l LEFT JOIN w USING (doc_id, ln) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos
)
SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (cut) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT cut), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
