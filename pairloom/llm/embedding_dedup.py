"""Near-equal embeddings by PCA-ordered tiles with early stopping.

Unit vectors are rotated so that the directions of most second moment come first; dot
products do not change. Within a label vectors are ordered by their first coordinate and
cut into tiles of bounded size. Two tiles are compared only if the boxes around their
first coordinates are near enough. A comparison adds up products over the leading
coordinates, bounds the rest by the product of the remaining norms, and goes on only with
pairs whose cosine can still reach the threshold. What remains is compared exactly.

Exact for any data. Equal vectors are one node, so a large group of copies costs nothing;
a tile pair returns counts and a spanning forest of its links, never its pairs. The
number of tile pairs is bounded by the square of a label's rows over the square of the
tile size, less what the boxes rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import partitions_for
from pairloom.operators.cluster import connected_components
from pairloom.session import materialize

COSINE = 0.98
TILE = 512
#: Rows per partition while tiles are cut.
SORTED_ROWS = 4096
#: Leading coordinates of a tile's box.
BOX = 8
#: Coordinates after which bounds are checked.
STEPS = (8, 16, 32)
#: Slack of the bounds for rounding; the last test is exact.
SLACK = 1e-9
#: Share of pairs alive under which they are followed one by one instead of as a matrix.
SPARSE = 0.05


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(number) > 0) & finite & F.exists(number, lambda x: x != 0), F.lit(False))


def _units(frame: pd.Series) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in frame])
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def second_moments(nodes: DataFrame, width: int) -> np.ndarray:
    """The matrix of summed products of coordinates over all unit vectors of one width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                units = _units(frame.vector)
                total += units.T @ units
        yield pd.DataFrame({"cell": np.arange(width * width), "value": total.ravel()})

    own = nodes.where(F.col("width") == width).select("vector")
    sums = own.mapInPandas(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for row in sums:
        out[row.cell] = row.value
    return out.reshape(width, width)


def cut_tiles(nodes: DataFrame, rotations: dict[int, np.ndarray], rows: int) -> DataFrame:
    """Stored tiles: (tile, label, width, nodes, times, units as bytes, low, high)."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                units = _units(part.vector)
                lead = units @ rotations[width][:, 0] if width in rotations else units[:, 0]
                yield pd.DataFrame(
                    {
                        "label": part.label, "width": part.width, "lead": lead, "node": part.node, "times": part.times,
                        "unit": [u.tobytes() for u in units],
                    }
                )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, kept, name = TaskContext.get().partitionId() << 32, [], None
        for frame in frames:
            for own, part in frame.groupby(["label", "width"], sort=False):
                if own != name and kept:
                    yield tile(number, name, pd.concat(kept))
                    number, kept = number + 1, []
                name = own
                kept.append(part)
                held = pd.concat(kept)
                while len(held) >= TILE:
                    yield tile(number, name, held.iloc[:TILE])
                    number, held = number + 1, held.iloc[TILE:]
                kept = [held] if len(held) else []
        if kept:
            yield tile(number, name, pd.concat(kept))

    def tile(number: int, name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        units = np.frombuffer(b"".join(part.unit), np.float64).reshape(len(part), -1)
        turned = units @ rotations[name[1]] if name[1] in rotations else units
        return pd.DataFrame(
            {
                "tile": [number], "label": [name[0]], "width": [name[1]],
                "nodes": [part.node.to_numpy()], "times": [part.times.to_numpy()], "units": [units.tobytes()],
                "low": [turned[:, :BOX].min(0)], "high": [turned[:, :BOX].max(0)],
            }
        )

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.mapInPandas(place, f"label {kind}, width int, lead double, node bigint, times bigint, unit binary")
    order = ["label", "width", "lead", "node"]
    ordered = placed.repartitionByRange(partitions_for(rows, SORTED_ROWS), *order).sortWithinPartitions(*order)
    return materialize(
        ordered.mapInPandas(
            cut,
            f"tile bigint, label {kind}, width int, nodes array<bigint>, times array<bigint>, units binary, "
            "low array<double>, high array<double>",
        ),
        "tiles",
    )


def tile_links(a: np.ndarray, b: np.ndarray, rotation: np.ndarray | None, cosine: float, same: bool):
    """Row numbers (i, j) of the pairs of unit rows with at least this cosine; i < j within one tile."""
    x, y = (a, b) if rotation is None else (a @ rotation, b @ rotation)
    rest_x, rest_y = (np.sqrt(np.cumsum((z * z)[:, ::-1], 1)[:, ::-1]) for z in (x, y))
    width, done = x.shape[1], 0
    total = np.zeros((len(a), len(b)))
    steps = [s for s in STEPS if s < width]
    i = j = None
    for step in steps:
        if i is None:
            total += x[:, done:step] @ y[:, done:step].T
            alive = total + np.outer(rest_x[:, step], rest_y[:, step]) >= cosine - SLACK
            if same:
                alive = np.triu(alive, 1)
            n = int(alive.sum())
            if n <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
                total = total[i, j]
        else:
            total = total + np.einsum("nd,nd->n", x[i, done:step], y[j, done:step])
            alive = total + rest_x[i, step] * rest_y[j, step] >= cosine - SLACK
            i, j, total = i[alive], j[alive], total[alive]
        done = step
        if i is not None and not len(i):
            return i, j
    if i is None:
        found = a @ b.T >= cosine
        return np.nonzero(np.triu(found, 1) if same else found)
    exact = np.einsum("nd,nd->n", a[i], b[j]) >= cosine
    return i[exact], j[exact]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number each of n members is connected with by the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare_tiles(tiles: DataFrame, rotations: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Stored (node, other, n): n links of a node, or (other not null) one link of the spanning forest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a = np.frombuffer(row.units_a, np.float64).reshape(-1, row.width)
                b = np.frombuffer(row.units_b, np.float64).reshape(-1, row.width)
                same = row.a == row.b
                i, j = tile_links(a, b, rotations.get(row.width), cosine, same)
                if not len(i):
                    continue
                nodes_a, nodes_b = np.asarray(row.nodes_a), np.asarray(row.nodes_b)
                na, nb = len(nodes_a), len(nodes_b)
                of_a = np.bincount(i, np.asarray(row.times_b)[j], na).astype(np.int64)
                of_b = np.bincount(j, np.asarray(row.times_a)[i], nb).astype(np.int64)
                members = nodes_a if same else np.concatenate([nodes_a, nodes_b])
                counts = of_a + of_b if same else np.concatenate([of_a, of_b])
                label = forest(i, j if same else j + na, len(members))
                child, linked = np.flatnonzero(label != np.arange(len(members))), np.flatnonzero(counts)
                yield pd.DataFrame(
                    {
                        "node": np.concatenate([members[linked], members[child]]),
                        "other": pd.array([None] * len(linked) + members[label[child]].tolist(), "Int64"),
                        "n": np.concatenate([counts[linked], np.zeros(len(child), np.int64)]),
                    }
                )

    boxes = tiles.select("tile", "label", "width", "low", "high")
    x = boxes.select("label", "width", F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    y = boxes.select("label", "width", F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gaps = F.zip_with(
        F.zip_with("low_a", "high_b", lambda p, q: F.greatest(p - q, F.lit(0.0))),
        F.zip_with("low_b", "high_a", lambda p, q: F.greatest(p - q, F.lit(0.0))),
        lambda p, q: p * p + q * q,
    )
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    near = x.join(y, ["label", "width"]).where((F.col("a") <= F.col("b")) & (distance <= 2 - 2 * cosine + SLACK))
    near = materialize(near.select("a", "b"), "tile_pairs")
    left = tiles.select(
        F.col("tile").alias("a"), "width", F.col("nodes").alias("nodes_a"), F.col("times").alias("times_a"), F.col("units").alias("units_a")
    )
    right = tiles.select(
        F.col("tile").alias("b"), F.col("nodes").alias("nodes_b"), F.col("times").alias("times_b"), F.col("units").alias("units_b")
    )
    return materialize(near.join(left, "a").join(right, "b").mapInPandas(run, "node bigint, other bigint, n bigint"), "tile_links")


def near_equal_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two rows are linked if their labels are equal and not null, their widths are equal,
    and their cosine in double precision is at least ``cosine``. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and form their
    own component, as do all rows of null label. ``component_id`` is the least id
    reachable; null ids are never the least. Repeated rows are vectors of their own and
    link with each other. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(
        vectors.select(
            F.col(vec_id).alias("vec_id"),
            F.monotonically_increasing_id().alias("uid"),
            F.col(label).alias("label"),
            F.when(usable(F.col(vector)) & F.col(label).isNotNull(), F.col(vector).cast("array<double>")).alias("vector"),
        ).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")}),
        "vectors",
    )
    key = ["label", "k1", "k2"]
    nodes = rows.where("vector is not null").groupBy(*key).agg(
        F.min("uid").alias("node"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector")
    )
    nodes = materialize(nodes.withColumn("width", F.size("vector")), "vector_nodes")
    widths = {r.width: r.n for r in nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(4).collect()}
    # The most common widths get their own rotation; any other keeps its coordinates, which changes no result.
    rotations = {w: np.linalg.eigh(second_moments(nodes, w))[1][:, ::-1].copy() for w in widths}
    tiles = cut_tiles(nodes, rotations, sum(widths.values()))
    found = compare_tiles(tiles, rotations, cosine)

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    known = (
        nodes.select(*key, "node", "times")
        .join(counts, "node", "left")
        .join(parts.withColumnRenamed("id", "node"), "node", "left")
        .select(*key, (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    )
    placed = rows.where("vector is not null").select("vec_id", *key).join(materialize(known, "known"), key)
    placed = materialize(placed.select("vec_id", "n_links", "part"), "placed")
    least = materialize(placed.groupBy("part").agg(F.min("vec_id").alias("component_id")), "least_ids")
    linked = placed.join(least, "part").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
