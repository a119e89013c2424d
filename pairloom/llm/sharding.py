"""Sharding by a minimax contiguous partition: shards of nearly equal bytes that never part equal texts.

The atoms are hash buckets of the text: all copies of a text lie in one bucket, and
buckets are ordered by number. The number of atoms is a parameter, so what the driver
sees (one sum per atom) is bounded whatever the table's size; the capacity search runs
on those sums.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import materialize

SHARDS = 16
#: Hex digits of the text's hash that name its atom: 16**4 atoms at most.
DIGITS = 4
#: Cells per shard in which slots are numbered; each holds about rows / (16 * cells) rows.
CELLS = 512


def cuts_for(sizes: list[int], shards: int) -> list[int]:
    """Where to cut the ordered atoms: the index at which each shard but the first begins.

    The least capacity for which greedy filling needs at most ``shards`` shards is found
    by binary search. No shard is larger than that; below it a shard ends at the fair
    share of what is left, if greedy filling still places the rest. So where one atom alone
    sets the capacity, the other shards are even.
    """
    ends = list(accumulate(sizes))
    if not sizes:
        return [0] * (shards - 1)

    def reach(start: int, capacity: int) -> int:
        return bisect_right(ends, (ends[start - 1] if start else 0) + capacity)

    def fits(start: int, capacity: int, left: int) -> bool:
        for _ in range(left):
            start = reach(start, capacity)
        return start == len(sizes)

    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(0, middle, shards):
            high = middle
        else:
            low = middle + 1
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        before = ends[start - 1] if start else 0
        share = before + (ends[-1] - before) / (left + 1)
        cut = min(bisect_left(ends, share) + 1, reach(start, low), len(sizes))
        if cut > start + 1 and ends[cut - 1] - share > share - ends[cut - 2]:
            cut -= 1  # ends nearer to the fair share
        start = cut if fits(cut, low, left) else reach(start, low)
        cuts.append(start)
    return cuts


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    digits: int = DIGITS,
    cells: int = CELLS,
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each input row.

    Law: shards are near equal in bytes. ``size`` is the text's UTF-8 bytes plus 1 (null
    counts as empty and shares a shard with empty texts). Equal texts share a shard, so a
    group larger than its fair share makes its shard as large as itself. ``slot`` numbers
    a shard's rows from 0 without gaps. Repeated rows and null ids are rows like any
    other. An empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(body.cast("binary")), 1, digits), 16, 10).cast("int").alias("atom"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int").alias("cell"),
        ),
        "shard_rows",
    )
    atoms = sorted((r.atom, r.bytes) for r in slim.groupBy("atom").agg(F.sum("size").alias("bytes")).collect())
    cuts = cuts_for([size for _, size in atoms], shards)
    placed = slim.withColumn("shard", _shard_of(F.col("atom"), [atoms[c][0] for c in cuts if c < len(atoms)]))
    return number_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def _shard_of(atom: Column, first_atoms: list[int]) -> Column:
    shard = F.lit(0)
    for first in first_atoms:
        shard = shard + (atom >= first).cast("int")
    return shard.cast("int")


def number_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots per shard: a number within the cell, plus the rows in the shard's earlier cells."""
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("within", within).join(F.broadcast(offsets), ["shard", "cell"]).withColumn(
        "slot", F.col("before") + F.col("within")
    )
