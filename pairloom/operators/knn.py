"""k-nearest-neighbour joins by cosine similarity.

All joins return ``(query_id, index_id, sim, rank)``: for each query row its ``k``
most similar index rows, ranked by the similarity rounded to six digits and then by
id, so equal scores always come out in the same order.

Queries and index rows meet in blocks of bounded size, and each pair of blocks emits the top
k of its queries, never its pairs. The joins differ in which blocks meet, at every size
in the same way:

* exact: all rows of both sides are cut into a grid of blocks, and each pair meets once; a task takes as
  many blocks as memory allows;
* cells: index rows lie in the leaves of a two-level tree of centres and a query visits the
  nearest leaves, itself a k-nearest-neighbour join with the leaves' centres;
* buckets: rows lie in buckets of random projections, and a query visits its own bucket
  and the nearest ones beside it.

How many leaves or buckets a query visits is measured: enough for the wanted recall on a
sample of the queries, whose true neighbours come from the exact join. A cell of any
size is cut into a grid of blocks, so one that holds a third of all rows becomes many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from pairloom.functions.text import shuffle_key
from pairloom.operators.kmeans import fit_centres, fit_within, unit_rows
from pairloom.session import materialize

DIGITS = 6
BLOCK_ROWS = 4096
TILE = 1 << 22  # similarities held at once
GRID_VALUES = 1 << 21  # vector components of a side that one task of the exact join holds
RECALL = 0.95  # share of true neighbours to be found among those of a sample of queries
SAMPLE = 256  # queries in that sample
COARSE_ROWS = 16_384  # index rows per cell of the upper level, while there are fewer such cells than sqrt(rows)
SLICE_ROWS = 65_536  # rows whose leaves are fitted together
PROBES = 1000  # sets of neighbouring buckets considered per band


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Unit rows as float64; a zero row stays zero."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit_rows(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64))


def _top(queries: np.ndarray, index: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rounded similarities of the k best index rows per query row.

    Similarity and position are packed in one integer, so a partial selection
    already honours the tie order (``index`` comes sorted by id).
    """
    n, m = len(queries), len(index)
    scale = 10**DIGITS
    kept = min(k, m)
    step = max(TILE // max(m, 1), 1)
    where, score = np.empty((n, kept), np.int64), np.empty((n, kept))
    for start in range(0, n, step):
        part = slice(start, min(start + step, n))
        packed = np.rint(queries[part] @ index.T * scale).astype(np.int64)
        packed = (2 * scale - packed) * m + np.arange(m)
        if skip is not None:
            hit = np.flatnonzero(skip[part] >= 0)
            packed[hit, skip[part][hit]] = np.iinfo(np.int64).max
        if kept < m:
            packed = np.partition(packed, kept - 1, axis=1)[:, :kept]
        packed.sort(axis=1)
        lost = packed == np.iinfo(np.int64).max
        where[part] = np.where(lost, -1, packed % m)
        score[part] = (2 * scale - packed // m) / scale
    return where, score


def _rows(query_ids: pa.Array, index_ids: pa.Array, where: np.ndarray, score: np.ndarray) -> list[pa.Array]:
    n, kept = where.shape
    flat = where.ravel()
    ok = flat >= 0
    source = np.repeat(np.arange(n), kept)[ok]
    return [query_ids.take(pa.array(source)), index_ids.take(pa.array(flat[ok])), pa.array(score.ravel()[ok])]


def _sorted_index(ids: pa.Array, matrix: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    order = pc.sort_indices(ids)
    return ids.take(order), matrix[order.to_numpy()]


def _own_position(query_ids: pa.Array, index_ids: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(query_ids, value_set=index_ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(df: DataFrame, name: str, dims: int) -> DataFrame:
    """``(name, v)`` without rows whose vector is missing or of another width."""
    usable = F.col("id").isNotNull() & (F.size("v") == dims)
    return df.filter(usable).select(F.col("id").alias(name), F.col("v"))


def vector_profile(df: DataFrame) -> tuple[int, int]:
    """The most common vector width and how many rows have it, in one pass."""
    widths = df.filter(F.col("v").isNotNull() & F.col("id").isNotNull()).groupBy(F.size("v").alias("d")).count()
    first = widths.orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        raise ValueError("the table holds no vectors")
    return first["d"], first["count"]


def _candidate_schema(queries: DataFrame, index: DataFrame) -> StructType:
    return StructType([
        StructField("query_id", queries.schema["query_id"].dataType),
        StructField("index_id", index.schema["index_id"].dataType),
        StructField("sim", DoubleType()),
    ])


def _ranked(candidates: DataFrame, k: int, repeats: bool = False) -> DataFrame:
    """Final top k. With ``repeats`` a pair may arrive once per band and counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "index_id")
    rank = F.dense_rank() if repeats else F.row_number()
    best = candidates.withColumn("rank", rank.over(order)).filter(F.col("rank") <= k)
    return best.dropDuplicates(["query_id", "index_id"]) if repeats else best


# --- block join ------------------------------------------------------------------


def _search(dims: int, k: int, exclude_self: bool, block_rows: int | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The top k of every query of one block among the index rows of another, which are taken ``block_rows`` at a time."""

    def search(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        ids, matrix = _sorted_index(_flat(right_rows["index_id"]), _matrix(right_rows["w"], dims))
        query_ids = _flat(left_rows["query_id"])
        where, score = np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0))
        if len(ids) and len(query_ids):
            asked = _matrix(left_rows["v"], dims)
            for start in range(0, len(ids), block_rows or len(ids)):
                part = slice(start, start + (block_rows or len(ids)))
                own_at = _own_position(query_ids, ids[part]) if exclude_self else None
                more = _top(asked, matrix[part], k, own_at)
                where, score = _best(where, score, np.where(more[0] < 0, -1, more[0] + start), more[1], k)
        return pa.Table.from_arrays(_rows(query_ids, ids, where, score), names=["query_id", "index_id", "sim"])

    return search


def _best(where: np.ndarray, score: np.ndarray, more_where: np.ndarray, more_score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists per query, in the order of ``_top``; a position of -1 is none."""
    if not where.shape[1]:
        return more_where, more_score
    where, score = np.concatenate([where, more_where], axis=1), np.concatenate([score, more_score], axis=1)
    order = np.lexsort((where, np.where(where < 0, np.inf, -score)), axis=1)[:, :k]
    return np.take_along_axis(where, order, axis=1), np.take_along_axis(score, order, axis=1)


def _block(key: str, count: int | str):
    return F.pmod(F.xxhash64(key), F.col(count) if isinstance(count, str) else F.lit(count)).cast("int")


def _each(count: int | str):
    return F.explode(F.sequence(F.lit(0), (F.col(count) if isinstance(count, str) else F.lit(count)) - 1))


def _grid_join(queries: DataFrame, index: DataFrame, k: int, dims: int, exclude_self: bool, query_blocks: int, index_blocks: int, block_rows: int) -> DataFrame:
    """All rows of both sides, cut into numbered parts by hash; each pair of parts meets in one task, ``block_rows`` index rows at a time."""
    left = queries.select("query_id", "v", _block("query_id", query_blocks).alias("qb"), _each(index_blocks).alias("ib"))
    right = index.select("index_id", F.col("v").alias("w"), _block("index_id", index_blocks).alias("ib"), _each(query_blocks).alias("qb"))
    joined = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib"))
    return joined.applyInArrow(_search(dims, k, exclude_self, block_rows), _candidate_schema(queries, index))


def _block_join(queries: DataFrame, index: DataFrame, k: int, dims: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """Join ``(query_id, v, cell)`` and ``(index_id, v, cell)`` on the cell and emit the
    top k of each query per block.

    A cell with i index and q query rows becomes ceil(i/block) x ceil(q/block)
    blocks, chosen by hash, so blocks stay near ``block_rows`` rows a side.
    """
    layout = materialize(cell_layout(queries, index, block_rows), "layout").select("cell", "q_blocks", "i_blocks")
    left = queries.join(layout, "cell").select(
        "query_id", "v", "cell", _block("query_id", "q_blocks").alias("qb"), _each("i_blocks").alias("ib"))
    right = index.join(layout, "cell").select(
        "index_id", F.col("v").alias("w"), "cell", _block("index_id", "i_blocks").alias("ib"), _each("q_blocks").alias("qb"))
    keys = ["cell", "ib", "qb"]
    joined = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return joined.applyInArrow(_search(dims, k, exclude_self), _candidate_schema(queries, index))


def cell_layout(queries: DataFrame, index: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(cell, nq, ni, q_blocks, i_blocks)`` of the cells that hold rows of both sides."""

    def counted(side: DataFrame, n: str, blocks: str) -> DataFrame:
        return side.groupBy("cell").agg(F.count("*").alias(n)).withColumn(blocks, F.ceil(F.col(n) / F.lit(block_rows)).cast("int"))

    return counted(index, "ni", "i_blocks").join(counted(queries, "nq", "q_blocks"), "cell")


def compared_share(queries: DataFrame, index: DataFrame, all_pairs: int) -> float:
    """Share of all pairs of a query and an index row that meet in cells; a pair that meets twice counts twice."""
    met = cell_layout(queries, index).agg(F.sum(F.col("nq") * F.col("ni")).alias("n")).first()["n"]
    return (met or 0) / all_pairs if all_pairs else 0.0


# --- exact -------------------------------------------------------------------------


def knn_join_exact(
    queries: DataFrame, index: DataFrame, k: int, *, exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
    profile: tuple[int, int] | None = None,
) -> DataFrame:
    """The k most similar ``index`` rows per row of ``queries``; both are ``(id, v)``.

    ``profile`` is the ``vector_profile`` of the index, if already known. Index rows are searched ``block_rows`` at a time,
    but a task holds as many blocks as memory allows: a row travels once for each part of the other side, not for each block.
    """
    dims, rows = profile or vector_profile(index)
    part_rows = max(block_rows, GRID_VALUES // dims)
    asking, searched = _vectors(queries, "query_id", dims), _vectors(index, "index_id", dims)
    asked = asking.count()
    # Few parts would leave cores idle: the larger side is cut further then.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    cut = [max(1, -(-n // part_rows)) for n in (asked, rows)]
    larger = 0 if asked >= rows else 1
    cut[larger] = max(cut[larger], min(cores, -(-max(asked, rows) // 64)))
    return _ranked(_grid_join(asking, searched, k, dims, exclude_self, *cut, block_rows), k)


# --- cells -------------------------------------------------------------------------


@dataclass(frozen=True)
class CellIndex:
    """The index side in a two-level tree: ``rows`` (index_id, v, coarse, cell), its leaves
    ``leaves`` (index_id: the cell, v: its centre, n, coarse), and the upper centres with their row counts."""

    rows: DataFrame
    leaves: DataFrame
    coarse: np.ndarray
    sizes: np.ndarray

    @property
    def dims(self) -> int:
        return self.coarse.shape[1]

    @property
    def n_rows(self) -> int:
        return int(self.sizes.sum())


def build_cells(
    index: DataFrame, seed: int = 42, profile: tuple[int, int] | None = None,
    coarse_rows: int = COARSE_ROWS, slice_rows: int = SLICE_ROWS,
) -> CellIndex:
    """Fit the tree on all rows ``(id, v)`` and assign them.

    The upper level is a mini-batch k-means of at most sqrt(n) centres. Below each centre
    the tasks that hold its rows fit about 2 sqrt(m) leaves for m rows; a cell with more than
    ``slice_rows`` rows is fitted in slices, each with leaves of its own.
    """
    dims, n = profile or vector_profile(index)
    rows = _vectors(index, "index_id", dims)
    cells = max(1, int(min(-(-n // coarse_rows), np.ceil(np.sqrt(n)))))
    coarse = unit_rows(fit_centres(rows.withColumnRenamed("index_id", "id"), cells, dims, seed, starts=1, unit=True))
    placed = materialize(assign_nearest(rows, coarse).select("index_id", "v", F.col("cell").alias("coarse")), "coarse")
    counted = placed.groupBy("coarse").agg(F.count("*").alias("n"))
    slices = materialize(counted.withColumn("slices", F.ceil(F.col("n") / F.lit(slice_rows)).cast("int")), "slices")
    sizes = np.zeros(len(coarse), np.int64)
    for row in slices.collect():
        sizes[row["coarse"]] = row["n"]
    sliced = placed.join(slices.select("coarse", "slices"), "coarse").select(
        "index_id", "v", "coarse", _block("index_id", "slices").alias("slice"))
    schema = StructType([*placed.schema.fields, StructField("cell", LongType())])

    def leaves(group: pa.Table) -> pa.Table:
        matrix = _matrix(group["v"], dims)
        at = fit_within(matrix, int(np.ceil(2 * np.sqrt(len(matrix)))), seed)
        first = (group["coarse"][0].as_py() << 40) | (group["slice"][0].as_py() << 20)
        return group.select(["index_id", "v", "coarse"]).append_column("cell", pa.array(at.astype(np.int64) + first))

    assigned = materialize(sliced.groupBy("coarse", "slice").applyInArrow(leaves, schema), "cells")
    return CellIndex(assigned, materialize(_centres(assigned, dims), "leaves"), coarse, sizes)


def _centres(assigned: DataFrame, dims: int) -> DataFrame:
    """``(index_id, v, n, coarse)``: the mean of the unit vectors of each cell."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from pairloom.functions.vectors import l2_normalize

    unit = array_to_vector(l2_normalize(F.col("v")))
    means = assigned.groupBy("coarse", "cell").agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(unit)).alias("v"))
    return means.select(F.col("cell").alias("index_id"), "v", "n", "coarse")


def assign_nearest(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``cell``, the most similar centre (the first on a tie), and ``angle`` to it.
    ``rows`` is an id and ``v``; the centres are a bounded model and are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    dims = centres.shape[1]
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    names = [f.name for f in schema.fields]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines = _matrix(batch.column(1), dims) @ shared.value.T
            cell = cosines.argmax(axis=1) if len(cosines) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cosines[np.arange(len(cosines)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=names)

    return rows.mapInArrow(nearest, schema)


def _coarse_visits(queries: DataFrame, built: CellIndex, wanted: int, probes: int) -> DataFrame:
    """``(query_id, v, cell)``: the upper cells that each query enters."""
    shared = queries.sparkSession.sparkContext.broadcast((built.coarse, built.sizes))
    cells = StructField("cells", ArrayType(IntegerType()))
    step, dims = max(TILE // len(built.coarse), 1), built.dims

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                chosen = _nearest_cells(_matrix(batch.column(1), dims) @ centres.T, sizes, wanted, probes)
                row, cell = np.nonzero(chosen)
                offsets = np.searchsorted(row, np.arange(len(chosen) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "v", "cells"])

    full = queries.mapInArrow(plan, StructType([*queries.schema.fields, cells]))
    return full.select("query_id", "v", F.explode("cells").alias("cell"))


def _nearest_cells(cosines: np.ndarray, sizes: np.ndarray, wanted: int, probes: int) -> np.ndarray:
    """Which cells are entered: the nearest ``probes``, and on until they hold ``wanted`` rows."""
    cosines = np.where(sizes > 0, cosines, -np.inf)
    order = np.argsort(-cosines, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    before = np.concatenate([np.zeros((len(order), 1), np.int64), held[:, :-1]], axis=1)
    take = ((np.arange(order.shape[1]) < probes) | (before < wanted)) & (sizes[order] > 0)
    chosen = np.zeros(cosines.shape, bool)
    np.put_along_axis(chosen, order, take, axis=1)
    return chosen


def _leaf_visits(queries: DataFrame, built: CellIndex, wanted: int, probes: tuple[int, int], block_rows: int) -> DataFrame:
    """``(query_id, cell)``: the leaves each query visits, found as its nearest leaf centres."""
    entered = _coarse_visits(queries, built, wanted, probes[0])
    centres = built.leaves.select("index_id", "v", F.col("coarse").alias("cell"))
    near = _ranked(_block_join(entered, centres, max(probes[1], wanted), built.dims, False, block_rows), max(probes[1], wanted))
    sized = near.join(built.leaves.select("index_id", "n"), "index_id")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    chosen = sized.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("rank") <= probes[1]) | (F.col("before") < wanted))
    return chosen.select("query_id", F.col("index_id").alias("cell"))


def _sample(queries: DataFrame, n: int, seed: int) -> DataFrame:
    return materialize(queries.orderBy(shuffle_key(["query_id"], seed)).limit(n), "sample")


def _reach(ranks: np.ndarray, share: float) -> int:
    """The least number of visits that reaches ``share`` of the neighbours; ``ranks`` count from 0."""
    return int(np.sort(ranks)[max(0, int(np.ceil(share * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def calibrate_cells(
    queries: DataFrame, built: CellIndex, k: int, recall: float = RECALL, sample: int = SAMPLE, seed: int = 42, exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> tuple[int, int]:
    """(upper cells, leaves) a query has to visit so that ``recall`` of the true k neighbours of a
    sample of queries lie there. The true neighbours come from the exact join with all rows."""
    drawn = _sample(_vectors(queries, "query_id", built.dims), sample, seed)
    index = built.rows.select(F.col("index_id").alias("id"), "v")
    true = knn_join_exact(
        drawn.select(F.col("query_id").alias("id"), "v"), index, k, exclude_self=exclude_self, block_rows=block_rows, profile=(built.dims, built.n_rows))
    true = materialize(true.join(built.rows.select("index_id", "coarse", "cell"), "index_id").select("query_id", "coarse", "cell"), "true")
    vectors = drawn.toArrow()
    place = {q: i for i, q in enumerate(vectors["query_id"].to_pylist())}
    cosines = np.where(built.sizes > 0, _matrix(vectors["v"], built.dims) @ built.coarse.T, -np.inf) if len(place) else np.zeros((0, len(built.sizes)))
    order = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
    upper = _reach(np.array([order[place[r["query_id"]], r["coarse"]] for r in true.collect()], np.int64), (1 + recall) / 2)
    entered = _coarse_visits(drawn, built, k, upper)
    centres = built.leaves.select("index_id", "v", F.col("coarse").alias("cell"))
    leaves = built.leaves.count()
    near = _ranked(_block_join(entered, centres, leaves, built.dims, False, block_rows), leaves)
    found = true.join(near.select("query_id", F.col("index_id").alias("cell"), "rank"), ["query_id", "cell"], "left")
    ranks = [leaves if r["rank"] is None else r["rank"] - 1 for r in found.select("rank").collect()]
    return upper, min(_reach(np.array(ranks, np.int64), recall), leaves)


def knn_join_cells(
    queries: DataFrame, index: DataFrame | CellIndex, k: int, *, recall: float = RECALL, probes: tuple[int, int] | None = None,
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, seed: int = 42, profile: tuple[int, int] | None = None,
    visited: DataFrame | None = None,
) -> DataFrame:
    """Approximate join over the leaves of a tree. Pass a ``CellIndex`` to reuse one index, ``visited`` to reuse its
    ``visited_leaves``, and ``probes`` (upper cells, leaves) to set the visits by hand. A query always gets min(k, index rows) neighbours."""
    built = index if isinstance(index, CellIndex) else build_cells(index, seed, profile)
    if visited is None:
        visited = visited_leaves(queries, built, k, recall, probes, exclude_self, block_rows, seed)
    return _ranked(_leaf_join(visited, _vectors(queries, "query_id", built.dims), built, k, exclude_self, block_rows), k)


def _leaf_join(visited: DataFrame, asking: DataFrame, built: CellIndex, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """The top k of each query among the leaves it visits, by slice of the index.

    A slice holds the leaves that were fitted together. A query travels once to a slice, with the list of leaves it
    visits there, and not once to each leaf; the queries of a slice are cut into blocks by hash.
    """
    part_rows, cores = max(block_rows, GRID_VALUES // built.dims), visited.sparkSession.sparkContext.defaultParallelism
    slice_of = F.shiftright("cell", 20)
    wanted = materialize(visited.groupBy("query_id", slice_of.alias("slice")).agg(F.collect_list("cell").alias("leaves")), "wanted")
    counted = materialize(wanted.groupBy("slice").agg(F.count("*").alias("n")), "layout")
    met = counted.agg(F.sum("n")).first()[0] or 0
    at_once = min(part_rows, max(64, -(-met // cores)))
    layout = counted.select("slice", F.ceil(F.col("n") / F.lit(at_once)).cast("int").alias("q_blocks"))
    left = wanted.join(layout, "slice").join(asking, "query_id").select("query_id", "v", "leaves", "slice", _block("query_id", "q_blocks").alias("qb"))
    right = built.rows.select("index_id", "v", "cell", slice_of.alias("slice")).join(layout, "slice").select(
        "index_id", "v", "cell", "slice", _each("q_blocks").alias("qb"))
    joined = left.groupBy("slice", "qb").cogroup(right.groupBy("slice", "qb"))
    return joined.applyInArrow(_search_leaves(built.dims, k, exclude_self, block_rows), _candidate_schema(asking, built.rows))


def _search_leaves(dims: int, k: int, exclude_self: bool, block_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The top k of every query ``(query_id, v, leaves)`` among the rows ``(index_id, v, cell)`` of the leaves it visits."""

    def search(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        query_ids, order = _flat(left_rows["query_id"]), pc.sort_indices(right_rows["index_id"])
        ids, cells = _flat(right_rows["index_id"]).take(order), _flat(right_rows["cell"]).take(order).to_numpy()
        where, score = np.full((len(query_ids), k), -1, np.int64), np.zeros((len(query_ids), k))
        if len(ids) and len(query_ids):
            asked, matrix = _matrix(left_rows["v"], dims), _matrix(right_rows["v"], dims)[order.to_numpy()]
            lists = _flat(left_rows["leaves"])
            leaf, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(query_ids)), pc.list_value_length(lists).to_numpy())
            # A query whose id is repeated visits a leaf once for each of its rows; each visit has an answer of its own.
            sort = np.lexsort((leaf, asker))
            leaf, asker = leaf[sort], asker[sort]
            begins = np.r_[True, (leaf[1:] != leaf[:-1]) | (asker[1:] != asker[:-1])]
            again = np.arange(len(leaf)) - np.maximum.accumulate(np.where(begins, np.arange(len(leaf)), 0))
            copies, asker = int(again.max()) + 1, asker + again * len(query_ids)
            query_ids, asked = pa.concat_arrays([query_ids] * copies), np.tile(asked, (copies, 1))
            where, score = np.tile(where, (copies, 1)), np.tile(score, (copies, 1))
            own = _own_position(query_ids, ids) if exclude_self else None
            by_leaf, by_cell = np.argsort(leaf, kind="stable"), np.argsort(cells, kind="stable")
            leaf, cells = leaf[by_leaf], cells[by_cell]
            for one in np.unique(leaf):
                whole = asker[by_leaf[np.searchsorted(leaf, one) : np.searchsorted(leaf, one, "right")]]
                held = by_cell[np.searchsorted(cells, one) : np.searchsorted(cells, one, "right")]
                blocks = itertools.product(range(0, len(whole), block_rows), range(0, len(held), block_rows))
                for rows, at in ((whole[i : i + block_rows], held[j : j + block_rows]) for i, j in blocks):
                    skip = None
                    if exclude_self:
                        place = np.minimum(np.searchsorted(at, own[rows]), len(at) - 1)
                        skip = np.where(at[place] == own[rows], place, -1)
                    more = _top(asked[rows], matrix[at], k, skip)
                    where[rows], score[rows] = _best(where[rows], score[rows], np.where(more[0] < 0, -1, at[more[0]]), more[1], k)
        return pa.Table.from_arrays(_rows(query_ids, ids, where, score), names=["query_id", "index_id", "sim"])

    return search


def cell_visits(
    queries: DataFrame, built: CellIndex, k: int, recall: float = RECALL, probes: tuple[int, int] | None = None,
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, seed: int = 42,
    visited: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, v, cell)``, stored: the leaves in which each query is answered."""
    if visited is None:
        visited = visited_leaves(queries, built, k, recall, probes, exclude_self, block_rows, seed)
    return visited.join(_vectors(queries, "query_id", built.dims), "query_id").select("query_id", "v", "cell")


def visited_leaves(
    queries: DataFrame, built: CellIndex, k: int, recall: float = RECALL, probes: tuple[int, int] | None = None,
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> DataFrame:
    """``(query_id, cell)``, stored: the leaves each query visits."""
    asking = _vectors(queries, "query_id", built.dims)
    wanted = k + 1 if exclude_self else k
    probes = probes or calibrate_cells(queries, built, k, recall, seed=seed, exclude_self=exclude_self, block_rows=block_rows)
    return materialize(_leaf_visits(asking, built, wanted, probes, block_rows), "visits")


def knn_join(queries: DataFrame, index: DataFrame | CellIndex, k: int, *, search: str = "cells", **options) -> DataFrame:
    """The join named by ``search``: 'exact', 'cells' or 'buckets', whatever the sizes."""
    if isinstance(index, CellIndex):
        options.pop("profile", None)
        return knn_join_cells(queries, index, k, **options)
    joins = {"exact": knn_join_exact, "cells": knn_join_cells, "buckets": knn_join_buckets}
    if search not in joins:
        raise ValueError(f"search is one of {sorted(joins)}")
    return joins[search](queries, index, k, **options)


def knn_self_join(df: DataFrame, k: int, *, search: str = "exact", **options) -> DataFrame:
    """The k nearest other rows of the same table."""
    return knn_join(df, df, k, search=search, exclude_self=True, **options)


# --- random-projection buckets -----------------------------------------------------


@dataclass(frozen=True)
class Projections:
    """Directions, shifts and bucket widths of ``bands`` x ``rows`` projections, and how many buckets a query visits."""

    directions: np.ndarray
    shifts: np.ndarray
    widths: np.ndarray
    bands: int
    probes: int = 1

    @property
    def rows(self) -> int:
        return self.directions.shape[1] // self.bands

    def places(self, matrix: np.ndarray) -> np.ndarray:
        """Where rows lie, in widths: rows x bands x projections of a band."""
        return ((matrix @ self.directions + self.shifts) / self.widths).reshape(len(matrix), self.bands, -1)

    def steps(self) -> np.ndarray:
        """The sets of neighbouring buckets: -1, 0 or 1 per projection, few changes first, PROBES at most."""
        out = [np.zeros(self.rows, np.int64)]
        for changes in range(1, self.rows + 1):
            more = []
            for at in itertools.combinations(range(self.rows), changes):
                for signs in itertools.product((-1, 1), repeat=changes):
                    step = np.zeros(self.rows, np.int64)
                    step[list(at)] = signs
                    more.append(step)
                if len(out) + len(more) > PROBES:
                    return np.array(out)
            out += more
        return np.array(out)

    def at_once(self, probes: int) -> int:
        """How many rows are probed together, so that their bucket keys stay within a tile."""
        return max(1, TILE // (self.bands * (len(self.steps()) + probes * (self.rows + 1))))

    def away(self, places: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each of ``steps`` around its own bucket: rows x bands x steps."""
        inside = places - np.floor(places)
        below, above = inside**2, (1 - inside) ** 2
        steps = self.steps()
        return below @ (steps == -1).T.astype(float) + above @ (steps == 1).T.astype(float)


def measure_projections(index: DataFrame, dims: int, rows: int, bands: int, seed: int) -> Projections:
    """Random directions whose bucket width is 2.5 times the measured spread of the projected rows, as
    many of them in a band as leave about 128 rows in a bucket, within bounds."""
    per_band = int(np.clip(np.round(np.log(max(rows, 2) / 128) / np.log(1.75)), 6, 12))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(dims, bands * per_band))
    shared = index.sparkSession.sparkContext.broadcast(directions)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims) @ shared.value
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x))), pa.array(x.sum(0)), pa.array((x**2).sum(0))],
                names=["at", "n", "s", "ss"])

    parts = index.select("v").mapInArrow(moments, "at long, n long, s double, ss double")
    spread = np.ones(directions.shape[1])
    for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect():
        variance = r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0
        spread[r["at"]] = np.sqrt(variance) if variance > 1e-12 else 1.0
    return Projections(directions, rng.uniform(0, 1, directions.shape[1]) * 2.5 * spread, 2.5 * spread, bands)


def _buckets(rows: DataFrame, projections: Projections, probing: bool) -> DataFrame:
    """``(id, v, cell)`` for the bucket of each band, and with ``probing`` for the nearest ones beside it."""
    shared = rows.sparkSession.sparkContext.broadcast(projections)
    dims = projections.directions.shape[0]
    schema = StructType([*rows.schema.fields, StructField("keys", ArrayType(ArrayType(LongType())))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        steps = own.steps()
        n = min(own.probes, len(steps)) if probing else 1
        at_once = own.at_once(n)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                places = own.places(_matrix(batch.column(1), dims))
                nearest = np.argsort(own.away(places), axis=2, kind="stable")[:, :, :n] if n > 1 else np.zeros((*places.shape[:2], 1), np.int64)
                keys = np.floor(places).astype(np.int64)[:, :, None, :] + steps[nearest]
                band = np.broadcast_to(np.arange(own.bands)[None, :, None, None], (*keys.shape[:3], 1))
                flat = np.concatenate([band, keys], axis=3)
                width, each = flat.shape[3], flat.shape[1] * flat.shape[2]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) * each + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * each), inner)
                yield pa.RecordBatch.from_arrays([*batch.columns, outer], names=[f.name for f in schema.fields])

    name = rows.columns[0]
    return rows.mapInArrow(place, schema).select(name, "v", F.explode("keys").alias("key")).select(name, "v", F.xxhash64("key").alias("cell"))


def true_neighbours(
    queries: DataFrame, index: DataFrame, k: int, profile: tuple[int, int], sample: int = SAMPLE, seed: int = 42, exclude_self: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a sample of queries and of their true neighbours, a row per pair."""
    dims = profile[0]
    drawn = _sample(_vectors(queries, "query_id", dims), sample, seed)
    true = knn_join_exact(drawn.select(F.col("query_id").alias("id"), "v"), index, k, exclude_self=exclude_self, profile=profile)
    met = true.join(drawn.select("query_id", F.col("v").alias("x")), "query_id").join(_vectors(index, "index_id", dims), "index_id").select("x", "v").toArrow()
    return _matrix(met["x"], dims), _matrix(met["v"], dims)


def calibrate_buckets(asked: np.ndarray, found: np.ndarray, projections: Projections, recall: float = RECALL) -> int | None:
    """How many buckets a band a query has to visit to meet ``recall`` of its neighbours; None if no number does."""
    if not len(asked):
        return 1
    asked, found = projections.places(asked), projections.places(found)
    wanted = np.floor(found).astype(np.int64) - np.floor(asked).astype(np.int64)
    known = {tuple(step): i for i, step in enumerate(projections.steps().tolist())}
    place = np.argsort(np.argsort(projections.away(asked), axis=2, kind="stable"), axis=2)
    ranks = np.full(wanted.shape[:2], len(known), np.int64)
    for i, band in np.ndindex(ranks.shape):
        at = known.get(tuple(wanted[i, band]))
        if at is not None:
            ranks[i, band] = place[i, band, at]
    needed = _reach(ranks.min(1), recall)
    return needed if needed <= len(known) else None


def bucket_sides(
    queries: DataFrame, index: DataFrame, k: int, bands: int | None = None, recall: float = RECALL, probes: int | None = None, seed: int = 42,
    exclude_self: bool = False, profile: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the buckets they meet in. Without ``bands`` they are doubled until the wanted recall can be reached."""
    profile = profile or vector_profile(index)
    dims, rows = profile
    searched = _vectors(index, "index_id", dims)
    pairs = None if probes else true_neighbours(queries, index, k, profile, seed=seed, exclude_self=exclude_self)
    tried = [bands] if bands else [1, 2, 4, 8, 16]
    for bands in tried:
        projections = measure_projections(searched, dims, rows, bands, seed)
        needed = probes or calibrate_buckets(*pairs, projections, recall)
        if needed:
            break
    needed = needed or len(projections.steps())
    projections = Projections(projections.directions, projections.shifts, projections.widths, bands, needed)
    return _buckets(_vectors(queries, "query_id", dims), projections, True), _buckets(searched, projections, False)


def knn_join_buckets(
    queries: DataFrame, index: DataFrame, k: int, *, bands: int | None = None, recall: float = RECALL, probes: int | None = None,
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, seed: int = 42, profile: tuple[int, int] | None = None,
    sides: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Approximate join over buckets of random projections. ``sides`` are its ``bucket_sides``, if already known.

    A band joins several projections to one bucket; a query meets the rows of its own bucket and of the
    nearest ones beside it, in each of ``bands`` bands (as few as reach the recall). Queries that meet fewer than k rows are
    answered over the cells of a tree instead.
    """
    profile = profile or vector_profile(index)
    dims, rows = profile
    asking, searched = sides or bucket_sides(queries, index, k, bands, recall, probes, seed, exclude_self, profile)
    met = materialize(_ranked(_block_join(asking, searched, k, dims, exclude_self, block_rows), k, repeats=True), "buckets")
    goal = min(k, rows - 1 if exclude_self else rows)
    served = materialize(met.groupBy("query_id").count().filter(F.col("count") >= goal).select("query_id"), "served")
    short = queries.join(served.select(F.col("query_id").alias("id")), "id", "left_anti")
    full = met.join(served, "query_id", "left_semi")
    if _vectors(short, "query_id", dims).isEmpty():
        return full
    return full.unionByName(knn_join_cells(short, index, k, recall=recall, exclude_self=exclude_self, seed=seed, profile=profile))
