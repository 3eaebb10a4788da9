"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
shared AS (SELECT k AS s FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON k = s GROUP BY doc_id
"""

RULES = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, {_BLANKS}) <> ''] AS ls
  FROM documents),
placed AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM docs),
windows AS (
  SELECT doc_id, pos, w, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM placed
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (
  SELECT doc_id, pos FROM windows WHERE w3 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
covered AS (
  SELECT doc_id, sum(n)::BIGINT AS n FROM (
    SELECT doc_id, least(3, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 3)) AS n FROM repeated)
  GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    2 * len(list_distinct(ls)) < len(ls) AS same_lines,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters,
    length(regexp_replace(t, '[^\\p{{L}}]+|\\p{{Lu}}+', '', 'g')) AS small
  FROM docs LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * word_chars >= 5 * n_words
    AND word_chars <= 12 * n_words AND 2 * (letters - small) <= letters AND NOT same_lines AS kept
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES, "op8_quality_rules": RULES}
