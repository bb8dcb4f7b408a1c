"""DuckDB SQL for document operators whose definition SQL can state."""

from __future__ import annotations

from collections.abc import Mapping

WORDS = r"[^\x20\x09-\x0D]+"
SUBSTRINGS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d
), g AS (
  SELECT r, w, i, CASE WHEN i + 34 <= n THEN md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM w
), c AS (
  SELECT *, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS again FROM g
), m AS (
  SELECT r, w, i, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c
), s AS (
  SELECT r, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM m GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


def quality(limits: Mapping[int, float], line_limit: float, min_words: int) -> str:
    grams = "".join(f", g{n} AS (SELECT r, i, CASE WHEN i + {n - 1} <= n AND count(*) OVER (PARTITION BY r, h) > 1 THEN 1 ELSE 0 END AS a FROM (SELECT r, i, n, CASE WHEN i + {n - 1} <= n THEN md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) END AS h FROM w))" for n in (3, *limits))
    grams += "".join(f", c{n} AS (SELECT r, sum(c)::BIGINT AS words, sum(c * length(w))::BIGINT AS chars FROM (SELECT r, i, max(a) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM g{n}) JOIN w USING (r, i) GROUP BY r)" for n in (3, *limits))
    joins = "".join(f" LEFT JOIN c{n} ON c{n}.r = d.r" for n in (3, *limits))
    columns = "".join(f", coalesce(c{n}.chars, 0) AS gram_{n}_chars" for n in limits)
    over = "".join(f" AND gram_{n}_chars <= {limit!r}::DOUBLE * word_chars" for n, limit in limits.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d
), l AS (
  SELECT r, line, list_sum(list_transform(regexp_extract_all(line, '{WORDS}'), lambda x: length(x))) AS chars, count(*) OVER (PARTITION BY r, line) AS times FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORDS}')
), ls AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, (sum(chars) FILTER (WHERE times > 1))::BIGINT AS dup_line_chars FROM l GROUP BY r
){grams}, t AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words{columns}, coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM d LEFT JOIN ls ON ls.r = d.r{joins}
), b AS (
  SELECT *, n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t
)
SELECT *, NOT base_failed AND dup_line_chars <= {line_limit!r}::DOUBLE * word_chars{over} AS kept FROM b"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d
), g AS (
  SELECT DISTINCT doc_id, h FROM (SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS h FROM w) WHERE i + 3 <= n OR n < 4 AND i = 1
), s AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), k AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * x >= 80 * (sa.n + sb.n - x)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, k.b FROM reach JOIN k ON k.a = reach.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
