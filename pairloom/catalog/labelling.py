"""Queries on labels, splits, selections and label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.catalog.base import SCORED_SQL, query, scored_pairs, stored_scores, vector_sides
from pairloom.operators import labels, sampling, select

BUDGET = 100
CONFUSED_SQL = f"confused AS (SELECT * FROM scored ORDER BY abs(p - 0.5), a_id, b_id LIMIT {BUDGET // 2})"
CONFIDENT_SQL = f"confident AS (SELECT * FROM scored ORDER BY p DESC, a_id, b_id LIMIT {BUDGET // 2})"
HYBRID_SQL = f"{SCORED_SQL}, {CONFUSED_SQL}, {CONFIDENT_SQL}, asked AS (SELECT * FROM confused UNION SELECT * FROM confident)"
SEED_PAIRS = 50
SPLIT_SQL = f"""{SCORED_SQL},
placed AS (SELECT a_id, b_id, label, row_number() OVER (ORDER BY md5(a_id || '#' || b_id || '#42'), a_id, b_id) AS place,
  count(*) OVER () AS n FROM scored),
split AS (SELECT a_id, b_id, label, CASE WHEN place <= least(n // 5, 20000) THEN 'val'
  WHEN place <= least(n // 5, 20000) + {SEED_PAIRS} THEN 'seed' ELSE 'pool' END AS part FROM placed)"""


@query("label_pairs", f"WITH {SCORED_SQL} SELECT a_id, b_id, label FROM scored")
def label_pairs(spark, sf):
    a, b = vector_sides(spark, sf)
    return labels.resolvable(scored_pairs(spark, sf), a, b).select("a_id", "b_id", "label")


@query("shuffle_split", f"WITH {SPLIT_SQL} SELECT a_id, b_id, part FROM split")
def shuffle_split(spark, sf):
    pairs = stored_scores(spark, sf).select("a_id", "b_id")
    return sampling.split_pool(pairs, labels.KEY, 0.2, 20_000, SEED_PAIRS)


@query("query_confused", f"WITH {SCORED_SQL}, {CONFUSED_SQL} SELECT * FROM confused")
def query_confused(spark, sf):
    return select.most_confused(scored_pairs(spark, sf), BUDGET // 2)


@query("query_confident", f"WITH {SCORED_SQL}, {CONFIDENT_SQL} SELECT * FROM confident")
def query_confident(spark, sf):
    return select.most_confident(scored_pairs(spark, sf), BUDGET // 2)


@query("query_hybrid", f"WITH {HYBRID_SQL} SELECT * FROM asked")
def query_hybrid(spark, sf):
    return select.hybrid(stored_scores(spark, sf), BUDGET)


@query("pool_minus_labeled", f"""WITH {HYBRID_SQL} SELECT a_id, b_id FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM asked x WHERE x.a_id = s.a_id AND x.b_id = s.b_id)""")
def pool_minus_labeled(spark, sf):
    scores = stored_scores(spark, sf)
    return labels.without(scores, select.hybrid(scores, BUDGET), bounded=True).select("a_id", "b_id")


@query("fuse_labels", f"""WITH {HYBRID_SQL}, {SPLIT_SQL.removeprefix(SCORED_SQL + ',')}
  SELECT a_id, b_id, label FROM split WHERE part = 'seed' UNION ALL SELECT a_id, b_id, label FROM asked""")
def fuse_labels(spark, sf):
    scores = stored_scores(spark, sf)
    parts = sampling.split_pool(scores, labels.KEY, 0.2, 20_000, SEED_PAIRS)
    seeds = parts.filter("part = 'seed'").select("a_id", "b_id", "label")
    return labels.fuse(seeds, select.hybrid(scores, BUDGET).select("a_id", "b_id", "label"))


@query("label_stats", f"""WITH {SCORED_SQL} SELECT count(*) AS n_labels, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos,
  sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::BIGINT AS n_neg FROM scored""")
def label_stats(spark, sf):
    return labels.label_stats(scored_pairs(spark, sf))


@query("class_weights", f"""WITH {SCORED_SQL} SELECT label, round((SELECT count(*) FROM scored) / 2.0 / count(*), 6)::DOUBLE AS weight
  FROM scored GROUP BY label""")
def class_weights(spark, sf):
    return labels.class_weights(scored_pairs(spark, sf)).withColumn("weight", F.round("weight", 6))
