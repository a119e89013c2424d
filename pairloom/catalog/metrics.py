"""Queries on thresholds, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.catalog.base import SCORED_SQL, query, scored_pairs, stored_scores, vector_truth
from pairloom.operators import evaluate

T1, T2 = 0.68, 0.7  # fixed thresholds of the two filter stages in these queries

RATES = """tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def counts_sql(source: str, decision: str) -> str:
    return f"""SELECT count(*) FILTER ({decision} AND label = 1) AS tp, count(*) FILTER ({decision} AND label = 0) AS fp,
  count(*) FILTER (NOT ({decision}) AND label = 1) AS fn FROM {source}"""


def _rounded(rates):
    return rates.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("threshold_filter", f"WITH {SCORED_SQL} SELECT a_id, b_id, p, CASE WHEN p > {T2} THEN 1 ELSE 0 END AS decision FROM scored WHERE p > {T1}")
def threshold_filter(spark, sf):
    kept = scored_pairs(spark, sf).filter(F.col("p") > T1)
    return kept.select("a_id", "b_id", "p", evaluate.above("p", T2).alias("decision"))


@query("pr_f1_candidates", f"WITH {SCORED_SQL}, c AS ({counts_sql('scored', f'p > {T1}')}) SELECT {RATES} FROM c")
def pr_f1_candidates(spark, sf):
    return _rounded(evaluate.confusion(scored_pairs(spark, sf), evaluate.above("p", T1)))


@query("pr_f1_survivors", f"""WITH {SCORED_SQL}, survivors AS (SELECT * FROM scored WHERE p > {T1}),
  c AS ({counts_sql('survivors', f'p > {T2}')}) SELECT {RATES} FROM c""")
def pr_f1_survivors(spark, sf):
    survivors = scored_pairs(spark, sf).filter(F.col("p") > T1)
    return _rounded(evaluate.confusion(survivors, evaluate.above("p", T2)))


@query("pr_f1_global", f"""WITH {SCORED_SQL}, c AS (SELECT tp, fp, total - tp AS fn FROM (
  SELECT count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp,
    (SELECT count(*) FROM (SELECT DISTINCT a_id, b_id FROM truth)) AS total FROM scored WHERE p > {T2})) SELECT {RATES} FROM c""")
def pr_f1_global(spark, sf):
    matches = scored_pairs(spark, sf).filter(F.col("p") > T2)
    return _rounded(evaluate.global_confusion(matches, vector_truth(spark, sf)))


CURVE_SQL = SCORED_SQL + """,
rolled AS (SELECT p AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY p),
running AS (SELECT threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS all_pos
  FROM rolled WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT threshold, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN all_pos > 0 THEN tp / all_pos ELSE 0 END AS recall FROM running),
curve AS (SELECT threshold, tp, fp, precision, recall, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM rates)"""
CURVE_COLUMNS = "threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("pr_curve", f"WITH {CURVE_SQL} SELECT {CURVE_COLUMNS} FROM curve")
def pr_curve(spark, sf):
    return _rounded(evaluate.pr_curve(stored_scores(spark, sf))).drop("all_pos")


@query("best_threshold", f"WITH {CURVE_SQL} SELECT {CURVE_COLUMNS} FROM (SELECT * FROM curve ORDER BY f1 DESC, threshold LIMIT 1)")
def best_threshold(spark, sf):
    return _rounded(evaluate.best_threshold(evaluate.pr_curve(stored_scores(spark, sf)))).drop("all_pos")


@query("select_threshold", f"""WITH {CURVE_SQL}, half AS (SELECT tp, fp, (SELECT (sum(pos))::BIGINT FROM rolled) AS all_pos
  FROM curve WHERE threshold > 0.5 ORDER BY threshold LIMIT 1),
best AS (SELECT threshold, f1 FROM curve ORDER BY f1 DESC, threshold LIMIT 1)
SELECT threshold, round(f1, 6) AS best_f1, coalesce((SELECT round(2 * tp / (tp + fp + all_pos), 6) FROM half), 0) AS f1_at_half FROM best""")
def select_threshold(spark, sf):
    """What a run does to choose its threshold."""
    chosen = evaluate.threshold_choice(stored_scores(spark, sf))
    return chosen.withColumns({c: F.round(c, 6) for c in ("best_f1", "f1_at_half")})
