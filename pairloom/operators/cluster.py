"""K-means chunks, nearest centre, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.operators.kmeans import fit_centres, nearest
from pairloom.operators.knn import assign_nearest, vector_profile
from pairloom.session import materialize, scratch


def kmeans_chunks(records: DataFrame, chunks: int, seed: int = 42, dims: int | None = None, centres: np.ndarray | None = None) -> DataFrame:
    """Add ``chunk`` to every record of one vector width: the nearest of the centres that
    mini-batch k-means fits on all records, or of those given."""
    if centres is None:
        dims = dims or vector_profile(records)[0]
        centres = fit_centres(records, chunks, dims, seed)
    shared = records.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest_of(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.array(v.tolist(), np.float64).reshape(len(v), -1), shared.value)[0].astype(np.int32))

    return records.filter(F.size("v") == centres.shape[1]).withColumn("chunk", nearest_of("v"))


def chunk_sizes(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("chunk").agg(F.count("*").alias("n"))


def nearest_centroid(records: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(id, centroid_id)``: the most similar of a few given centroids ``(id, v)``.

    The centroids are model-sized and travel as one broadcast matrix; ties go to
    the lowest centroid id.
    """
    rows = centroids.select("id", F.col("v").cast("array<double>").alias("v")).orderBy("id").collect()
    if not rows:
        raise ValueError("no centroids given")
    centres = np.array([r["v"] for r in rows])
    names = F.array(*[F.lit(r["id"]) for r in rows])
    assigned = assign_nearest(records.select("id", F.col("v").cast("array<double>").alias("v")), centres)
    return assigned.select("id", names[F.col("cell")].alias("centroid_id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for undirected edges ``(src, dst)``; a component is named after
    its smallest member.

    Alternates two steps until nothing changes. A small star links a vertex and its
    smaller neighbours to the smallest of them; a large star links the larger
    neighbours of a vertex to the smallest member of its neighbourhood. Each round
    about halves the longest path whatever the order of ids, so a chain settles in a
    logarithm of its length. Minima combine on the map side and are stored before
    they are joined, so that a hub's edges can be split. Self-loops are vertices too.
    """
    both = edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low"))
    stars = materialize(both.filter("high <> low").distinct(), "edges")
    rounds = 0
    while not _settled(stars):
        rounds += 1
        with scratch(edges.sparkSession) as keep:
            stars = keep(_large_star(_small_star(stars)))
    connected_components.rounds = rounds
    members = stars.select(F.col("high").alias("id"), F.col("low").alias("component"))
    named = stars.select(F.col("low").alias("id"), F.col("low").alias("component"))
    loops = edges.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    return members.unionByName(named).unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))


def _settled(stars: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour and none of those has a smaller one itself."""
    sides = stars.select(F.col("high").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(
        stars.select(F.col("low").alias("id"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    seen = sides.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return seen.filter((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("downs") == 1))).isEmpty()


def _small_star(stars: DataFrame) -> DataFrame:
    least = materialize(stars.groupBy("high").agg(F.min("low").alias("least")), "least")
    onward = stars.join(least, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return materialize(onward.unionByName(least.select("high", F.col("least").alias("low"))).distinct(), "stars")


def _large_star(stars: DataFrame) -> DataFrame:
    around = stars.select(F.col("high").alias("mid"), "low").unionByName(
        stars.select(F.col("low").alias("mid"), F.col("low").alias("low")))
    least = materialize(around.groupBy("mid").agg(F.min("low").alias("least")), "least")
    onward = stars.join(least, stars["low"] == least["mid"]).select("high", F.col("least").alias("low"))
    return materialize(onward.distinct(), "stars")


def cluster_count(clustered: DataFrame, column: str = "cluster") -> DataFrame:
    return clustered.agg(F.countDistinct(column).alias("n_clusters"))
