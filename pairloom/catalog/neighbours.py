"""Queries on vectors, neighbours, pair features and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom.catalog.base import (
    K, KNN_SQL, TRUTH_SQL, document_classes, documents, neighbour_pairs, query, table, vector_sides, vectors,
)
from pairloom.functions.strings import jaro_winkler
from pairloom.functions.vectors import cosine, l2_normalize
from pairloom.operators import cluster, embed, features, kmeans, knn, labels, noisy, records
from pairloom.operators.models import score_linear as linear_score
from pairloom.operators.truth import class_edges
from pairloom.session import materialize

@query("l2_normalize", """SELECT vec_id AS id, unnest(range(len(v)))::INTEGER AS pos, round(unnest([x / n for x in v]), 6) AS value
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def l2_normalized(spark, sf):
    unit = vectors(spark, sf).select("id", F.posexplode(l2_normalize(F.col("v"))).alias("pos", "value"))
    return unit.withColumn("value", F.round("value", 6))


@query("cosine_pairs", """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    rows = vectors(spark, sf)
    left = rows.select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"), F.col("v").alias("v_a"))
    right = rows.select(F.col("id").alias("b_id"), F.col("v").alias("v_b"))
    sim = F.round(cosine(F.col("v_a"), F.col("v_b")), 6)
    return left.join(right, "b_id").select("a_id", "b_id", sim.alias("sim"))


@query("knn_join_exact", f"WITH {KNN_SQL} SELECT a_id, b_id, sim, rank::INTEGER AS rank FROM knn")
def knn_join_exact(spark, sf):
    return neighbour_pairs(spark, sf)


@query("knn_join_exact_cells", f"WITH {KNN_SQL} SELECT a_id, b_id, sim, rank::INTEGER AS rank FROM knn")
def knn_join_exact_cells(spark, sf):
    """The same join over a grid of many small blocks."""
    a, b = vector_sides(spark, sf)
    return labels.as_pairs(knn.knn_join_exact(b, a, K, block_rows=128))


@query("knn_ivf_all_cells", f"WITH {KNN_SQL} SELECT a_id, b_id, sim, rank::INTEGER AS rank FROM knn")
def knn_ivf_all_cells(spark, sf):
    """The tree search with every leaf visited, which is the exact join."""
    a, b = vector_sides(spark, sf)
    return labels.as_pairs(knn.knn_join_cells(b, a, K, probes=(2**30, 2**30)))


@query("knn_self_join", """SELECT query_id, index_id, sim, rank::INTEGER AS rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS index_id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) DESC, i.vec_id) AS rank
  FROM embeddings q JOIN embeddings i ON i.vec_id <> q.vec_id) WHERE rank <= 4""")
def knn_self_join(spark, sf):
    return knn.knn_self_join(vectors(spark, sf), 4)


@query("knn_join_ivf")
def knn_join_ivf(spark, sf):
    a, b = vector_sides(spark, sf)
    return labels.as_pairs(knn.knn_join_cells(b, a, K))


@query("knn_join_lsh")
def knn_join_lsh(spark, sf):
    a, b = vector_sides(spark, sf)
    return labels.as_pairs(knn.knn_join_buckets(b, a, K))


def recall_of(found, exact):
    """Share of the exact neighbours that an approximate join found."""
    keys = ["a_id", "b_id"]
    hits = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hits.agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query("knn_recall")
def knn_recall(spark, sf):
    """Recall of both approximate joins, and the share of all pairs each compares."""
    exact = materialize(neighbour_pairs(spark, sf), "exact")
    a, b = vector_sides(spark, sf)
    profile = knn.vector_profile(a)
    built = knn.build_cells(a, profile=profile)
    visits = knn.visited_leaves(b, built, K)
    pairs = b.count() * profile[1]
    sides = knn.bucket_sides(b, a, K, profile=profile)
    shares = {"ivf": knn.compared_share(knn.cell_visits(b, built, K, visited=visits), built.rows, pairs), "lsh": knn.compared_share(*sides, pairs)}
    found = {"ivf": knn.knn_join_cells(b, built, K, visited=visits), "lsh": knn.knn_join_buckets(b, a, K, profile=profile, sides=sides)}
    rows = [
        recall_of(labels.as_pairs(found[m]), exact).select(F.lit(m).alias("method"), "n", "recall", F.lit(round(shares[m], 4)).alias("compared"))
        for m in ("ivf", "lsh")
    ]
    return rows[0].unionByName(rows[1])


@query("candidate_pool", f"WITH {KNN_SQL} SELECT DISTINCT a_id, b_id FROM knn")
def candidate_pool(spark, sf):
    a, b = vector_sides(spark, sf)
    return labels.candidate_pool(knn.knn_join_exact(b, a, K))


# --- features --------------------------------------------------------------------------

PAIRED_SQL = KNN_SQL + """,
paired AS (SELECT k.a_id, k.b_id, a.v AS x, b.v AS y FROM knn k JOIN va a ON a.id = k.a_id JOIN vb b ON b.id = k.b_id),
feats AS (SELECT a_id, b_id, list_concat(list_concat(x, y), list_concat(
  [abs(z[1] - z[2]) for z in list_zip(x, y)], [z[1] * z[2] for z in list_zip(x, y)])) AS f FROM paired)"""


def paired_vectors(spark, sf):
    a, b = vector_sides(spark, sf)
    return features.attach_records(neighbour_pairs(spark, sf).select("a_id", "b_id"), a, b)


@query("pair_features", f"""WITH {PAIRED_SQL} SELECT a_id, b_id, pos, round(value, 6) AS value FROM (
  SELECT a_id, b_id, unnest(range(len(f)))::INTEGER AS pos, unnest(f) AS value FROM feats)""")
def pair_features(spark, sf):
    dims, _ = knn.vector_profile(vectors(spark, sf))
    rows = features.exploded(features.pair_features(paired_vectors(spark, sf), dims))
    return rows.withColumn("value", F.round("value", 6))


@query("hybrid_features", f"""WITH {PAIRED_SQL} SELECT a_id, b_id, pos, round(value, 6) AS value FROM (
  SELECT a_id, b_id, unnest(range(len(h)))::INTEGER AS pos, unnest(h) AS value FROM (
    SELECT f.a_id, f.b_id, list_append(f, jaro_winkler_similarity(coalesce(p.p_name, ''), coalesce(q.p_name, ''))) AS h
    FROM feats f LEFT JOIN part p ON p.p_partkey = f.a_id LEFT JOIN part q ON q.p_partkey = f.b_id))""")
def hybrid_features(spark, sf):
    dims, _ = knn.vector_profile(vectors(spark, sf))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    named = vectors(spark, sf).join(names, "id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    pairs = neighbour_pairs(spark, sf).select("a_id", "b_id")
    attached = features.attach_records(pairs, named, named, ["v", "name"])
    return features.exploded(features.hybrid_features(attached, dims, "name")).withColumn("value", F.round("value", 6))


@query("feature_moments", f"""WITH {PAIRED_SQL} SELECT pos, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (
  SELECT unnest(range(len(f)))::INTEGER AS pos, unnest(f) AS value FROM feats) GROUP BY pos""")
def feature_moments(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dims, _ = knn.vector_profile(vectors(spark, sf))
    ready = features.pair_features(paired_vectors(spark, sf), dims)
    summary = ready.select(Summarizer.metrics("mean", "std").summary(array_to_vector("features")).alias("s"))
    arrays = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"))
    return summary.select(F.posexplode(arrays).alias("pos", "m")).select(
        "pos", F.round("m.mean", 6).alias("mean"), F.round("m.std", 6).alias("std"))


@query("score_linear", f"""WITH {PAIRED_SQL} SELECT a_id, b_id, round(1 / (1 + exp(-list_dot_product(f,
  [((i * 7) % 11 - 5) / 10.0 for i in range(len(f))]::DOUBLE[]))), 6) AS p FROM feats""")
def score_linear(spark, sf):
    dims, _ = knn.vector_profile(vectors(spark, sf))
    ready = features.pair_features(paired_vectors(spark, sf), dims)
    weights = [((i * 7) % 11 - 5) / 10.0 for i in range(4 * dims)]
    return ready.select("a_id", "b_id", F.round(linear_score(F.col("features"), weights), 6).alias("p"))


@query("jaro_winkler_pairs", """SELECT a.p_partkey AS a_id, b.p_partkey AS b_id,
  round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS name_sim
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def jaro_winkler_pairs(spark, sf):
    parts = table(spark, sf, "part")
    left = parts.select(F.col("p_partkey").alias("a_id"), (F.col("p_partkey") + 1).alias("b_id"), F.col("p_name").alias("x"))
    right = parts.select(F.col("p_partkey").alias("b_id"), F.col("p_name").alias("y"))
    pairs = left.join(right, "b_id")
    scored = pairs.select("x", "y").distinct().withColumn("name_sim", F.round(jaro_winkler(F.col("x"), F.col("y")), 6))
    return pairs.join(scored, ["x", "y"]).select("a_id", "b_id", "name_sim")


# --- clusters -----------------------------------------------------------------------------


@query("nearest_centroid", """SELECT id, centroid_id FROM (
  SELECT e.vec_id AS id, c.vec_id AS centroid_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY
    list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r
  FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4) c) WHERE r = 1""")
def nearest_centroid(spark, sf):
    rows = vectors(spark, sf)
    return cluster.nearest_centroid(rows, rows.select("id", "v").orderBy("id").limit(4))


@query("kmeans_chunks")
def kmeans_chunks(spark, sf):
    return cluster.kmeans_chunks(vectors(spark, sf).select("id", "v"), 4).select("id", "chunk")


@query("kmeans_update", """WITH seeds AS (SELECT embedding::DOUBLE[] AS c, row_number() OVER (ORDER BY vec_id) - 1 AS centre
  FROM embeddings ORDER BY vec_id LIMIT 4),
near AS (SELECT vec_id, embedding::DOUBLE[] AS v, arg_min(centre, (list_distance(embedding::DOUBLE[], c), centre)) AS centre,
  min(list_distance(embedding::DOUBLE[], c)) AS away FROM embeddings, seeds GROUP BY ALL),
sizes AS (SELECT centre, count(*) AS n, sum(away * away) AS cost FROM near GROUP BY centre),
means AS (SELECT centre, pos, avg(value) AS value FROM (
  SELECT centre, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS value FROM near) GROUP BY centre, pos)
SELECT m.centre, n, round(cost, 4) AS cost, pos, round(value, 6) AS value FROM means m JOIN sizes s ON s.centre = m.centre""")
def kmeans_update(spark, sf):
    """One whole-table step of k-means from the four vectors of the lowest ids."""
    rows = vectors(spark, sf)
    seeds = np.array([r["v"] for r in rows.orderBy("id").limit(4).collect()], np.float64)
    moved = kmeans.one_pass(rows, seeds[None], batch=None)
    return moved.select("centre", "n", F.round("cost", 4).alias("cost"), F.posexplode("v").alias("pos", "value")).withColumn(
        "value", F.round("value", 6))


@query("embed_hashing")
def embed_hashing(spark, sf):
    docs = records.prepare_records(documents(spark, sf).select("id", "body"), ["body"], "d")
    rows = embed.embed_hashing(docs, dims=64).select("id", F.posexplode("v").alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 5))


EDGES_SQL = """
edges AS (SELECT src, dst, sim FROM (
  SELECT q.vec_id AS src, i.vec_id AS dst, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) DESC, i.vec_id) AS r
  FROM embeddings q JOIN embeddings i ON i.vec_id <> q.vec_id) WHERE r <= 4)"""
RECORDS_SQL = """
recs AS (SELECT vec_id AS id, label AS cluster, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM embeddings)"""
NEGATIVES_SQL = """
negatives AS (SELECT e.src AS first_id, e.dst AS second_id, 0.0::DOUBLE AS label FROM edges e
  JOIN recs s ON s.id = e.src JOIN recs d ON d.id = e.dst WHERE s.cluster <> d.cluster)"""
POSITIVES_SQL = """
positives AS (SELECT f.first_id, b.id AS second_id, 1.0::DOUBLE AS label FROM recs b
  JOIN (SELECT cluster, min(id) AS first_id FROM recs WHERE source = 'a' GROUP BY cluster) f ON f.cluster = b.cluster
  WHERE b.source = 'b')"""


def _clustered(spark, sf):
    source = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    return vectors(spark, sf).select("id", "v", F.col("label").alias("cluster"), source.alias("source"))


@query("cluster_negatives", f"WITH {EDGES_SQL}, {RECORDS_SQL}, {NEGATIVES_SQL} SELECT * FROM negatives")
def cluster_negatives(spark, sf):
    rows = _clustered(spark, sf)
    return noisy.cluster_negatives(noisy.neighbour_edges(rows), rows)


@query("cluster_positives", f"WITH {RECORDS_SQL}, {POSITIVES_SQL} SELECT * FROM positives")
def cluster_positives(spark, sf):
    return noisy.cluster_positives(_clustered(spark, sf), "a", "b")


@query("mine_noisy_pairs", f"""WITH {EDGES_SQL}, {RECORDS_SQL}, {NEGATIVES_SQL}, {POSITIVES_SQL}
  SELECT * FROM negatives UNION ALL SELECT * FROM (SELECT * FROM positives
    ORDER BY md5(first_id || '#' || second_id || '#42') LIMIT (SELECT count(*) FROM negatives))""")
def mine_noisy_pairs(spark, sf):
    rows = _clustered(spark, sf)
    edges = materialize(noisy.neighbour_edges(rows), "edges")
    return noisy.mine_noisy_pairs(rows.drop("v"), edges, "a", "b")


@query("knn_components", f"""WITH RECURSIVE {EDGES_SQL},
strong AS (SELECT src, dst FROM edges WHERE sim >= 0.35 UNION SELECT dst, src FROM edges WHERE sim >= 0.35),
reach AS (SELECT src AS id, src AS other FROM strong UNION SELECT r.id, s.dst FROM reach r JOIN strong s ON s.src = r.other),
comps AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)
SELECT v.vec_id AS id, coalesce(c.cluster, v.vec_id) AS cluster FROM embeddings v LEFT JOIN comps c ON c.id = v.vec_id""")
def knn_components(spark, sf):
    rows = vectors(spark, sf)
    return noisy.similarity_clusters(rows, noisy.neighbour_edges(rows), 0.35)


@query("document_components", f"""WITH RECURSIVE {TRUTH_SQL},
strong AS (SELECT a_id AS src, b_id AS dst FROM truth UNION SELECT b_id, a_id FROM truth),
reach AS (SELECT src AS id, src AS other FROM strong UNION SELECT r.id, s.dst FROM reach r JOIN strong s ON s.src = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def document_components(spark, sf):
    """Near-copy groups: components of the document truth graph."""
    return cluster.connected_components(class_edges(document_classes(spark, sf)))
