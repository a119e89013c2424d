"""The two-stage resolution with given scorers, checked end to end.

Stage 1 scores the candidates by cosine, stage 2 what is left by a logistic score of their features.
A tenth of the pairs counts as labelled and is left out of the held-out scope.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.catalog.base import K, query, vector_sides, vector_truth
from pairloom.catalog.metrics import RATES, counts_sql
from pairloom.catalog.neighbours import PAIRED_SQL
from pairloom.operators.knn import vector_profile
from pairloom.operators.models import FixedScorer
from pairloom.plans.resolve import Resolution, resolution_metrics, resolve
from pairloom.session import materialize

T1, T2 = 0.62, 0.5


def weights_of(dims: int) -> tuple[float, ...]:
    """Small weights by place; more for the products of both vectors, which add up to the cosine."""
    return tuple([((i * 7) % 11 - 5) / 20.0 for i in range(3 * dims)] + [6.0] * dims)


BIAS = -2.0
LABELLED = "(a_id + b_id) % 20 = 3"
FIXED_SQL = PAIRED_SQL + f""",
truth AS (SELECT a_id, b_id FROM (
  SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS rank FROM sims) WHERE rank <= 2),
stage1 AS (SELECT k.a_id, k.b_id, k.sim, CASE WHEN t.a_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label,
  (list_dot_product(f.x, f.y) / (sqrt(list_dot_product(f.x, f.x)) * sqrt(list_dot_product(f.y, f.y))) + 1) / 2 AS p1
  FROM knn k JOIN paired f ON f.a_id = k.a_id AND f.b_id = k.b_id LEFT JOIN truth t ON t.a_id = k.a_id AND t.b_id = k.b_id),
stage2 AS (SELECT s.a_id, s.b_id, s.label, s.p1, 1 / (1 + exp(-(list_dot_product(f.f,
  [CASE WHEN i < len(f.f) // 4 * 3 THEN ((i * 7) % 11 - 5) / 20.0 ELSE 6.0 END for i in range(len(f.f))]::DOUBLE[]) + {BIAS}))) AS p2
  FROM stage1 s JOIN feats f ON f.a_id = s.a_id AND f.b_id = s.b_id WHERE s.p1 > {T1}),
matches AS (SELECT * FROM stage2 WHERE p2 > {T2})"""


def fixed_resolution(spark, sf) -> tuple[Resolution, object]:
    a, b = vector_sides(spark, sf)
    truth = materialize(vector_truth(spark, sf), "truth")
    dims, rows = vector_profile(a)
    first = FixedScorer(dims, T1)
    second = FixedScorer(dims, T2, weights_of(dims), BIAS)
    # A whole unit row: the cosine of stage 1 is a plain product.
    return resolve(_unit(a), _unit(b), truth, first, second, K, search="exact", profile=(dims, rows)), truth


def _unit(rows):
    from pairloom.functions.vectors import l2_normalize

    return rows.withColumn("v", l2_normalize(F.col("v")))


UNIT_SQL = FIXED_SQL.replace("embedding::DOUBLE[] AS v", "[e / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) for e in embedding::DOUBLE[]] AS v")


@query("resolve_fixed", f"""WITH {UNIT_SQL},
unseen AS (SELECT * FROM stage1 WHERE NOT ({LABELLED})),
c1 AS ({counts_sql('stage1', f'p1 > {T1}')}), c2 AS ({counts_sql('stage2', f'p2 > {T2}')}), c4 AS ({counts_sql('unseen', f'p1 > {T1}')}),
c3 AS (SELECT tp, fp, total - tp AS fn FROM (SELECT count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp,
  (SELECT count(*) FROM truth) AS total FROM matches))
SELECT 'candidates' AS scope, {RATES}, {T1}::DOUBLE AS threshold FROM c1
UNION ALL SELECT 'survivors', {RATES}, {T2}::DOUBLE FROM c2
UNION ALL SELECT 'global', {RATES}, {T2}::DOUBLE FROM c3
UNION ALL SELECT 'held_out', {RATES}, {T1}::DOUBLE FROM c4""")
def resolve_fixed(spark, sf):
    """Metrics of all four scopes."""
    done, truth = fixed_resolution(spark, sf)
    metrics = resolution_metrics(done, truth, done.candidates.filter(LABELLED).select("a_id", "b_id"))
    return metrics.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("resolve_fixed_matches", f"WITH {UNIT_SQL} SELECT a_id, b_id, label, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM matches")
def resolve_fixed_matches(spark, sf):
    done, _ = fixed_resolution(spark, sf)
    return done.matches.withColumns({c: F.round(c, 6) for c in ("p1", "p2")})
