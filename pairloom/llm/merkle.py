"""A Merkle manifest by time-forward processing.

The manifest is a forest of 16-ary trees, one per group, under a tree over the groups'
roots. A node is labelled by its group, its block and its place; what a node computes is
sent to the node that needs it as a message under the receiver's label, and nodes are
processed in the order of their labels. Upwards children's digests travel to their parents;
a reversed sweep then carries to every leaf the siblings on its way to the root.

A block is a subtree two levels high. Messages inside a block wait in a heap of at most a
few hundred entries; messages between blocks are rows of a stored table, which Spark's
external sort brings to their receivers in label order. So a pass over the nodes climbs two
levels, whatever the size of a group, and no task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import materialize

ARITY = 16
#: Levels of a block.
HEIGHT = 2
BLOCK = ARITY**HEIGHT
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows handed on at once.
ROWS = 4096


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record_digest(*fields: Column) -> Column:
    """Hash of a record: each field ``-`` if null, else its UTF-8 bytes, a colon and its value."""
    written = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.when(w.isNull(), "-").otherwise(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w)) for w in written
    ]), 256)


def levels_above(total: int, most: int = HEIGHT) -> int:
    """Levels until ``total`` nodes have become one, ``most`` at most."""
    n = 0
    while total > 1 and n < most:
        total, n = -(-total // ARITY), n + 1
    return n


def climb(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of all nodes of a block by level, from its leaves up."""
    made = [digests] + [[] for _ in range(levels)]
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(digests)]  # sorted, so a heap already
    while queue and queue[0][0] <= levels:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heappop(queue)[3])
        own = digest("".join(children))
        made[level].append(own)
        heappush(queue, (level + 1, index // ARITY, index % ARITY, own))
    return made


def descend(made: list[list[str]], way: str) -> Iterator[tuple[int, str]]:
    """(leaf, its way to the root), last leaf first, given the way of the block's top.

    A way is, for each level, the node's place in its run in hexadecimal, the siblings in
    order and a full stop.
    """
    queue = [(1 - len(made), 0, way)]
    while queue:
        level, index, above = heappop(queue)
        if not level:
            yield -index, above
            continue
        first = -index * ARITY
        run = made[-level - 1][first : first + ARITY]
        for place in range(len(run)):
            siblings = "".join(run[:place] + run[place + 1 :])
            heappush(queue, (level + 1, -(first + place), f"{place:x}{siblings}.{above}"))


def siblings_on(way: str) -> str:
    """The proof: all siblings on a way, level by level, left to right."""
    return "".join(level[1:] for level in way.split("."))


def fold(leaf: str, way: str) -> str:
    """The root that a leaf has if the siblings on its way are right."""
    for level in way.split(".")[:-1]:
        cut = 1 + 64 * int(level[0], 16)
        leaf = digest(level[1:cut] + leaf + level[cut:])
    return leaf


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` stored with ``place``, their number within ``grp`` from 0, and ``total``, their count.

    Rows are sorted by ranges; equal rows fall into ranges at random, so no group and no
    repeated row makes a range large. Places are the rows of the same group in earlier
    ranges plus the number within the range.
    """
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["grp", *order, "salt"]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = materialize(ranges.drop("salt").select("*", F.spark_partition_id().alias("range"), within.alias("within")), f"{name}-ranges")
    parts = ranges.groupBy("grp", "range").agg(F.min("within").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = materialize(parts, f"{name}-parts")
    before = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "grp", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    placed = ranges.join(materialize(offsets, f"{name}-offsets"), ["grp", "range"])
    return placed.withColumn("place", F.col("within") + F.col("offset")).drop("range", "within", "offset")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt by block and sorted by label, messages (without a place) before nodes."""
    return rows.withColumn("block", F.coalesce(F.floor(F.col("place") / BLOCK), F.col("block"))).repartition(
        "grp", "block").sortWithinPartitions("grp", "block", F.col("place").asc_nulls_first())


def by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks, one after the other, from sorted rows in any batches."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        changes = (frame.grp.ne(frame.grp.shift()) | frame.block.ne(frame.block.shift())).to_numpy().nonzero()[0].tolist()
        for start, end in zip(changes, [*changes[1:], len(frame)]):
            part = frame.iloc[start:end]
            if kept and (kept[-1].grp.iloc[0], kept[-1].block.iloc[0]) != (part.grp.iloc[0], part.block.iloc[0]):
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def in_batches(rows: Iterator[tuple], columns: list[str], n: int = ROWS) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def sweep_up(nodes: DataFrame) -> DataFrame:
    """The top node of every block, as a node of the next pass."""
    columns = ["grp", "place", "digest", "total"]

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for block in by_block(frames):
            total = int(block.total.iloc[0])
            levels = levels_above(total)
            top = climb(block.digest.tolist(), levels)[-1]
            yield block.grp.iloc[0], block.block.iloc[0], top[0], -(-total // ARITY**levels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_batches(tops(frames), columns)

    dealt = blocks(nodes.select(*columns).withColumn("block", F.lit(None).cast("long")))
    return dealt.mapInPandas(run, "grp string, place long, digest string, total long")


def sweep_down(nodes: DataFrame, messages: DataFrame, give: Callable, columns: list[str], schema: str) -> DataFrame:
    """What ``give`` makes of every node and its way; ``messages`` (grp, block, way, subroot, root) bring each block
    the way of its top."""
    extra = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c != "grp"]
    sent = messages.select("grp", "block", "way", "subroot", "root", *extra)
    waiting = nodes.select(
        "grp", F.lit(None).cast("long").alias("block"), *[F.lit(None).cast("string").alias(c) for c in ("way", "subroot", "root")],
        *[c for c in nodes.columns if c != "grp"])

    def given(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for block in by_block(frames):
            message, own = block.iloc[0], block.iloc[1:]
            made = climb(own.digest.tolist(), levels_above(int(own.total.iloc[0])))
            rows = list(own.itertuples(index=False))
            for i, way in descend(made, message.way):
                yield give(rows[i], way, message)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_batches(given(frames), columns)

    return blocks(sent.unionByName(waiting)).mapInPandas(run, schema)


def climb_all(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every pass, first the leaves, and the root of each group."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    passes = [nodes]
    while True:
        above = materialize(sweep_up(passes[-1]), f"{name}-nodes")
        most = -(-most // BLOCK)
        if most == 1:
            return passes, above
        passes.append(above)


def _node_way(node, way: str, message) -> tuple:
    return node.grp, node.place, way, message.subroot, message.root


MESSAGE = "grp string, block long, way string, subroot string, root string"


def descend_all(passes: list[DataFrame], messages: DataFrame, name: str) -> DataFrame:
    """Messages for the blocks of the leaves, from those for the groups' roots."""
    for nodes in reversed(passes[1:]):
        columns = [f.split()[0] for f in MESSAGE.split(", ")]
        messages = materialize(sweep_down(nodes, messages, _node_way, columns, MESSAGE), f"{name}-ways")
    return messages


def merkle_manifest(
    docs: DataFrame,
    fields: list[str],
    group: str = "source",
    doc_id: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    with_proofs: bool = False,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, way]) for every row.

    A leaf hashes the row's ``fields``. Leaves ascend by id within their group (null ids
    first, equal ids by digest; rows alike in all fields are interchangeable), groups by
    name (null first, then bytewise). ``tampered`` names fields that were changed after the
    manifest was made, with their values now: ``folded_root`` is what the leaf of today gives
    with the siblings of the manifest, ``verified`` whether that is the root. ``with_proofs``
    adds the way itself. Null and empty values differ; texts are hashed whole; a lone leaf is
    its group's root, a lone group's root is the root, and either has no siblings; an empty
    table gives no rows; other columns are ignored.
    """
    now = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    kind = docs.schema[doc_id].dataType.simpleString()
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),  # sorts as the groups do
        F.col(doc_id).alias("doc_id"),
        record_digest(*[F.col(f) for f in fields]).alias("digest"),
        record_digest(*[now[f] for f in fields]).alias("today"))
    leaves = materialize(number_rows(leaves, ["doc_id", "digest"], "leaf"), "leaves")
    passes, subroots = climb_all(leaves, "group")
    groups = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    groups = materialize(number_rows(groups, ["name"], "groups"), "groups")
    upper, roots = climb_all(groups, "root")
    start = roots.select("grp", F.lit(0).cast("long").alias("block"), F.lit("").alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def to_group(node, way: str, message) -> tuple:
        return node.name, 0, way, node.digest, message.root

    columns = [f.split()[0] for f in MESSAGE.split(", ")]
    messages = materialize(sweep_down(groups, descend_all(upper, start, "root"), to_group, columns, MESSAGE), "group-ways")

    def to_leaf(node, way: str, message) -> tuple:
        folded = fold(node.today, way)
        proof = digest(siblings_on(way))
        out = (node.doc_id, node.digest, message.subroot, message.root, proof, folded, folded == message.root)
        return (*out, way) if with_proofs else out

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", way string" * with_proofs
    columns = [f.split()[0] for f in schema.split(", ")]
    named = passes[0].withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make doubles of numbers with nulls
    made = sweep_down(named, descend_all(passes, messages, "group"), to_leaf, columns, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))
