"""Classes of near copies in SQL: all pairs of texts that share a shingle, and what can be reached by links."""

from __future__ import annotations

from pairloom.llm.rules_sql import WHITE

COPIES_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
texts AS (SELECT row_number() OVER () AS t, body, trim(lower(body), {WHITE}) AS low FROM (SELECT DISTINCT body FROM docs)),
words AS (SELECT t, CASE WHEN low = '' THEN [] ELSE string_split_regex(low, '[\x20\x09-\x0D]+') END AS w FROM texts),
held AS (SELECT DISTINCT t, s FROM (
  SELECT t, array_to_string(w[i:i + 4], chr(1)) AS s FROM (SELECT t, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT t, array_to_string(w, chr(1)) FROM words WHERE len(w) BETWEEN 0 AND 4)),
sizes AS (SELECT t, count(*) AS n FROM held GROUP BY t),
common AS (SELECT a.t AS x, b.t AS y, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.t <> b.t GROUP BY a.t, b.t),
links AS (SELECT x, y FROM common JOIN sizes n ON n.t = x JOIN sizes m ON m.t = y WHERE 9 * c >= 4 * (n.n + m.n)),
reach AS (SELECT t, t AS other FROM texts UNION SELECT r.t, l.y FROM reach r JOIN links l ON l.x = r.other),
parts AS (SELECT t, min(other) AS part FROM reach GROUP BY t),
placed AS (SELECT doc_id, part FROM docs JOIN texts USING (body) JOIN parts USING (t)),
classes AS (SELECT part, min(doc_id) AS class_id FROM placed GROUP BY part)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM placed JOIN classes USING (part)"""
