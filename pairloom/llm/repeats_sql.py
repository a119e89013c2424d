"""Removal of repeated passages in SQL: every window by itself, on hexadecimal text."""

from __future__ import annotations

WIDTH = 400

REPEATS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n FROM docs),
windows AS (SELECT row, i, md5(substr(h, 2 * i + 1, {2 * WIDTH})) AS k
  FROM (SELECT row, h, unnest(range(0, n - {WIDTH - 1})) AS i FROM sized WHERE n >= {WIDTH})),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
marked AS (SELECT row, i, CASE WHEN i > lag(i) OVER (PARTITION BY row ORDER BY i) + {WIDTH} THEN 1 ELSE 0 END AS new FROM twice),
numbered AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS span FROM marked),
spans AS (SELECT row, span, min(i) AS a, max(i) + {WIDTH} AS b FROM numbered GROUP BY row, span),
edges AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM spans),
pieces AS (SELECT e.row, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
  FROM edges e JOIN sized s ON s.row = e.row GROUP BY e.row)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM sized s LEFT JOIN pieces p ON p.row = s.row"""
