"""Candidate pairs and their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

KEY = ["a_id", "b_id"]


def candidate_pool(neighbours: DataFrame, index_side: str = "a") -> DataFrame:
    """Distinct ``(a_id, b_id)`` from a neighbour table, whichever side was searched."""
    a, b = ("index_id", "query_id") if index_side == "a" else ("query_id", "index_id")
    return neighbours.select(F.col(a).alias("a_id"), F.col(b).alias("b_id")).distinct()


def as_pairs(neighbours: DataFrame, index_side: str = "a") -> DataFrame:
    """Neighbour rows as ``(a_id, b_id, sim, rank)``."""
    a, b = ("index_id", "query_id") if index_side == "a" else ("query_id", "index_id")
    return neighbours.select(F.col(a).alias("a_id"), F.col(b).alias("b_id"), "sim", "rank")


def label_pairs(pairs: DataFrame, truth: DataFrame, bounded: bool = False) -> DataFrame:
    """Add ``label``: 1.0 if the pair is in the truth, else 0.0.

    Set ``bounded`` for pair sets whose size the label budget limits: then the
    truth is filtered by the broadcast pairs and does not move.
    """
    hits = truth.select(*KEY)
    if bounded:
        hits = hits.join(F.broadcast(pairs.select(*KEY)), KEY, "left_semi")
    hits = hits.distinct().withColumn("_hit", F.lit(1.0))
    return pairs.join(hits, KEY, "left").withColumn("label", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def resolvable(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs whose two records exist."""
    a_ids, b_ids = a.select(F.col("id").alias("a_id")), b.select(F.col("id").alias("b_id"))
    return pairs.join(a_ids, "a_id", "left_semi").join(b_ids, "b_id", "left_semi")


def without(pool: DataFrame, taken: DataFrame, bounded: bool = False) -> DataFrame:
    """The pool minus the pairs already labelled."""
    keys = taken.select(*KEY)
    return pool.join(F.broadcast(keys) if bounded else keys, KEY, "left_anti")


def fuse(*sets: DataFrame) -> DataFrame:
    """Stack label sets, keeping repeats."""
    return reduce(DataFrame.unionByName, sets)


def label_stats(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("n_labels"),
        F.sum(F.when(F.col("label") == 1.0, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("label") == 1.0, 0).otherwise(1)).alias("n_neg"),
    )


def class_weights(labelled: DataFrame) -> DataFrame:
    """Balanced weights ``total / 2 / count`` for both classes, 1 for a class that is absent."""
    counts = label_stats(labelled)

    def weight(count: str):
        return F.when(F.col(count) > 0, F.col("n_labels") / 2.0 / F.col(count)).otherwise(1.0)

    rows = F.array(
        F.struct(F.lit(0.0).alias("label"), weight("n_neg").alias("weight")),
        F.struct(F.lit(1.0).alias("label"), weight("n_pos").alias("weight")),
    )
    return counts.select(F.inline(rows))
