"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from credence.llm.line_dedup import LENGTH, MARKS

_MARKS = MARKS.replace("'", "''")

#: Lines and passages of LENGTH words that stand at an earlier place, by windows over all words.
LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM split),
cells AS (SELECT *, regexp_extract_all(body, '\s*\S+') AS cell, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS ws FROM line),
placed AS (SELECT *, len(ws) AS n, coalesce(sum(len(ws)) OVER before, 0)::BIGINT AS unit, coalesce(sum(length(body) + 1) OVER before, 0)::BIGINT AS base
  FROM cells WINDOW before AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
norm AS (SELECT *, lower(array_to_string(ws, ' ')) AS whole FROM placed WHERE n > 0),
again AS (SELECT doc_id, unit, n, row_number() OVER (PARTITION BY coalesce(nullif(trim(whole, '{_MARKS}'), ''), whole) ORDER BY doc_id, unit) AS r FROM norm),
word AS (SELECT doc_id, line, base, unit + k - 1 AS pos, ws[k] AS word, length(ws[k]) AS size, length(cell[k]) AS wide FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM norm)),
spot AS (SELECT *, base + sum(wide) OVER (PARTITION BY doc_id, line ORDER BY pos) AS till FROM word),
doc AS (SELECT doc_id, list(lower(word) ORDER BY pos) AS ws FROM word GROUP BY doc_id),
pass AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + {LENGTH}], ' ')) AS h FROM (SELECT *, unnest(range(0, len(ws) - {LENGTH} + 1)) AS pos FROM doc WHERE len(ws) >= {LENGTH})),
first AS (SELECT *, first_value(doc_id) OVER a AS fd, first_value(pos) OVER a AS fp FROM pass WINDOW a AS (PARTITION BY h ORDER BY doc_id, pos)),
gone AS (SELECT doc_id, unnest(range(unit, unit + n)) AS pos FROM again WHERE r > 1
  UNION SELECT doc_id, unnest(range(pos, pos + {LENGTH})) FROM first WHERE doc_id <> fd OR pos - fp >= {LENGTH}),
state AS (SELECT s.*, g.pos IS NOT NULL AS gone FROM spot s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos),
island AS (SELECT doc_id, min(till - size)::BIGINT || '-' || max(till)::BIGINT AS span, min(pos) AS begin_pos
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM state WHERE gone) GROUP BY doc_id, k),
spans AS (SELECT doc_id, string_agg(span, ',' ORDER BY begin_pos) AS removed FROM island GROUP BY doc_id),
kept AS (SELECT doc_id, line, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS rest, bool_or(gone) AS touched FROM state GROUP BY doc_id, line),
lines AS (SELECT l.doc_id, l.line, CASE WHEN touched THEN rest ELSE body END AS body FROM line l LEFT JOIN kept k ON l.doc_id = k.doc_id AND l.line = k.line),
out AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS text FROM lines WHERE body IS NOT NULL GROUP BY doc_id),
final AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(s.removed, '') AS removed
  FROM documents d LEFT JOIN out o USING (doc_id) LEFT JOIN spans s USING (doc_id))
SELECT doc_id, text, length(text) AS n_chars, removed FROM final"""

#: Shares of kept terms by group and language in whole numbers; sources pair by their language, terms above the language's share rank.
DIVERGENCE = r"""
WITH doc AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
whole AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
vocab AS (SELECT k.lang, term, v, 1 + (1000000000::HUGEINT * (k.n + 5)) // (w.n + 5 * v) AS q FROM kept k JOIN whole w USING (lang)),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM word JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
cell AS (SELECT t.lang, t.source, term, coalesce(c, 0) AS c, q, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (t.n + 5 * v) AS p
  FROM tot t JOIN vocab USING (lang) LEFT JOIN cnt USING (lang, source, term)),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM cell WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
