"""The line rules in SQL."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, CASE WHEN trim(body, {WHITE}) = '' THEN [] ELSE string_split_regex(trim(body, {WHITE}), '[\x20\x09-\x0D]+') END AS w,
  list_filter(string_split(body, chr(10)), lambda x: trim(x, {WHITE}) <> '') AS lines FROM docs),
windows AS (SELECT row, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
twins AS (SELECT row, unnest([i, i + 1, i + 2]) AS i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT i) AS n_repeat_words FROM twins GROUP BY row),
texts AS (SELECT host, body, list_filter(list_transform(string_split(lower(regexp_replace(body, '[ \x09\x0B-\x0D]+', ' ', 'g')), chr(10)),
  lambda x: trim(x, ' ')), lambda x: x <> '') AS own FROM (SELECT DISTINCT host, body FROM docs)),
held AS (SELECT host, body, unnest(own) AS line FROM texts),
frequent AS (SELECT host, line FROM held GROUP BY host, line HAVING count(DISTINCT body) > 20),
removed AS (SELECT host, body, sum(length(line) - length(replace(line, ' ', '')) + 1) AS gone FROM held SEMI JOIN frequent USING (host, line) GROUP BY host, body),
counted AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(s.body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
  FROM split s LEFT JOIN repeats r ON r.row = s.row LEFT JOIN removed m ON m.host = s.host AND m.body = s.body),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AS kept, n_removed_words FROM judged"""
