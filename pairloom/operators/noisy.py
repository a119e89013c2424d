"""Noisy training pairs from clusters on the neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.operators.cluster import connected_components
from pairloom.operators.knn import knn_self_join
from pairloom.operators.sampling import exact_sample
from pairloom.session import materialize


def cluster_negatives(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Neighbour edges ``(src, dst)`` whose ends lie in different clusters ``(id, cluster)``."""
    ends = clusters.select("id", "cluster")
    src = ends.select(F.col("id").alias("src"), F.col("cluster").alias("src_cluster"))
    dst = ends.select(F.col("id").alias("dst"), F.col("cluster").alias("dst_cluster"))
    crossed = edges.join(src, "src").join(dst, "dst").filter("src_cluster <> dst_cluster")
    return crossed.select(F.col("src").alias("first_id"), F.col("dst").alias("second_id"), F.lit(0.0).alias("label"))


def cluster_positives(records: DataFrame, source_a: str, source_b: str) -> DataFrame:
    """The first A record of each cluster with every B record of that cluster.

    ``records`` is ``(id, cluster, source)``. There is one A per cluster, so the
    output grows with the B rows and never with the square of a cluster.
    """
    first = records.filter(F.col("source") == source_a).groupBy("cluster").agg(F.min("id").alias("first_id"))
    first = materialize(first, "first")
    partners = records.filter(F.col("source") == source_b).select("cluster", F.col("id").alias("second_id"))
    return partners.join(first, "cluster").select("first_id", "second_id", F.lit(1.0).alias("label"))


def mine_noisy_pairs(records: DataFrame, edges: DataFrame, source_a: str, source_b: str, seed: int = 42) -> DataFrame:
    """Negatives between clusters and at most as many positives inside them."""
    negatives = cluster_negatives(edges, records)
    positives = cluster_positives(records, source_a, source_b)
    balanced = exact_sample(positives, negatives.count(), ["first_id", "second_id"], seed)
    return negatives.unionByName(balanced)


def neighbour_edges(records: DataFrame, k: int = 5, search: str = "exact") -> DataFrame:
    """``(src, dst, sim)`` to the k - 1 nearest other records."""
    near = knn_self_join(records, k - 1, search=search)
    return near.select(F.col("query_id").alias("src"), F.col("index_id").alias("dst"), "sim")


def similarity_clusters(records: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """``(id, cluster)``: components of the edges at or above ``cutoff``; records without
    such an edge form a cluster of their own."""
    found = connected_components(edges.filter(F.col("sim") >= cutoff))
    return records.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("cluster"))


def bootstrap_noisy_labels(records: DataFrame, source_a: str, source_b: str, cutoff: float = 0.8, k: int = 5, search: str = "exact") -> DataFrame:
    """Neighbour graph, clusters and noisy pairs for stacked records ``(id, source, v)``."""
    edges = materialize(neighbour_edges(records, k, search), "edges")
    clustered = records.select("id", "source").join(similarity_clusters(records, edges, cutoff), "id")
    return mine_noisy_pairs(clustered, edges, source_a, source_b)
