"""Mini-batch k-means over all rows of a table.

A pass is one Spark job. Every task walks its rows in small batches and moves its own copy
of the centres, a centre's step being one over the rows it has seen; the tasks' centres are
then averaged by those counts. Several starts are fitted in the same passes and the one
with the least cost wins. What the driver holds are the centres, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import shuffle_key

BATCH = 256
STARTS = 3
PASSES = 8
#: A pass that lowers the cost by less than this share is the last.
SETTLED = 1e-3


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def vector_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row by Euclidean distance, the first of equals, and the squared distance."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0)
    away = (centres**2).sum(1) - 2 * rows @ centres.T
    at = away.argmin(1)
    return at, np.maximum(away[np.arange(len(rows)), at] + (rows**2).sum(1), 0)


def update(centres: np.ndarray, seen: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """Move each centre to the mean of what it had seen and its rows of one batch."""
    new = np.bincount(at, minlength=len(centres))
    sums = np.zeros_like(centres)
    np.add.at(sums, at, rows)
    hit = new > 0
    seen[hit] += new[hit]
    centres[hit] += (sums[hit] - new[hit, None] * centres[hit]) / seen[hit, None]


def one_pass(vectors: DataFrame, centres: np.ndarray, batch: int | None = BATCH, unit: bool = False) -> DataFrame:
    """(start, centre, n, cost, v): where the rows ``(v)`` of all tasks move ``centres``
    (starts x k x dims), how many rows each took, and their squared distances to the centres given. Without ``batch`` all rows go by
    the centres given, so the means are exact."""
    dims = centres.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = ["start", "centre", "n", "cost", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        own, seen, cost = given.copy(), np.zeros(given.shape[:2], np.int64), np.zeros(given.shape[:2])
        for arrow in batches:
            rows = vector_matrix(arrow.column(0), dims)
            rows = unit_rows(rows) if unit else rows
            for start in range(len(given)):
                at, away = nearest(rows, given[start])
                cost[start] += np.bincount(at, away, len(given[start]))
                if batch is None:
                    update(own[start], seen[start], rows, at)
                    continue
                for first in range(0, len(rows), batch):
                    part = rows[first : first + batch]
                    update(own[start], seen[start], part, nearest(part, own[start])[0])
        start, centre = np.nonzero(seen + (cost > 0))
        total = own[start, centre] * seen[start, centre][:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * dims), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(start), pa.array(centre), pa.array(seen[start, centre]), pa.array(cost[start, centre]), lists], names=names)

    moved = vectors.select("v").mapInArrow(run, "start long, centre long, n long, cost double, total array<double>")
    total = Summarizer.sum(array_to_vector("total"))
    summed = moved.groupBy("start", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(total).alias("total"))
    return summed.select("start", "centre", "n", "cost", F.transform("total", lambda x: x / F.greatest("n", F.lit(1))).alias("v"))


def fit_centres(
    records: DataFrame, k: int, dims: int, seed: int = 42, batch: int = BATCH, starts: int = STARTS, passes: int = PASSES, unit: bool = False
) -> np.ndarray:
    """``k`` centres of all records ``(id, v)`` of width ``dims``; fewer if there are fewer records. With ``unit``
    rows are brought to length 1 first."""
    rows = records.filter(F.size("v") == dims)
    drawn = rows.orderBy(shuffle_key(["id"], seed)).limit(k * starts).select(F.col("v").cast("array<double>").alias("v")).collect()
    if not drawn:
        raise ValueError("no vectors to cluster")
    first = np.array([r["v"] for r in drawn])
    first = unit_rows(first) if unit else first
    k = min(k, len(first))
    starts = max(1, min(starts, len(first) // k))
    centres = first[: starts * k].reshape(starts, k, dims)
    before = np.inf
    for _ in range(passes):
        moved = one_pass(rows, centres, batch, unit).collect()
        cost = np.zeros(starts)
        for row in moved:
            cost[row["start"]] += row["cost"]
        best = int(cost.argmin())
        if before < np.inf and cost[best] > before * (1 - SETTLED):
            break
        before, kept = cost[best], centres[best]
        centres = centres.copy()
        for row in moved:
            if row["n"]:
                centres[row["start"], row["centre"]] = row["v"]
    else:
        kept = centres[best]
    return kept


def fit_within(rows: np.ndarray, k: int, seed: int = 42, rounds: int = 8, tile: int = 1 << 22) -> np.ndarray:
    """The centre (0 to k - 1) of each unit row, fitted in memory; for groups of bounded size."""
    k = min(k, len(rows))
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    step = max(tile // k, 1)
    for last in range(rounds, -1, -1):
        at = np.concatenate([(rows[i : i + step] @ centres.T).argmax(1) for i in range(0, len(rows), step)])
        if not last:
            return at
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        taken = np.bincount(at, minlength=k) > 0
        centres = np.where(taken[:, None], unit_rows(sums), centres)
