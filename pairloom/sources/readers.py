"""Readers for record and truth files; every column is read as a string.

A quoted cell may hold line breaks, so a line need not be a record. Files stay splittable
all the same: a line is a function of whether a quoted cell is open at its start, and
functions compose. Each block of a file is composed in its own task, the blocks of a file are
composed in turn (a row each), and then every line knows whether it begins a record.
Files without such cells are parsed line by line, without a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.config import MatchConfig, SourceFormat
from pairloom.session import materialize

#: More lines than this in one record mean a quote that is never closed.
RECORD_LINES = 10_000


def _strings(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


class _Cells:
    """Patterns for the cells of a line; a doubled quote is the escape inside a quoted cell, as in RFC 4180."""

    def __init__(self, separator: str) -> None:
        sep = "\\" + separator if separator in "|.^$*+?()[]{}\\" else separator
        inside = '[^"]*+(?:""[^"]*+)*+'
        quoted = f'"{inside}"[^{sep}]*+'
        cells = f'(?:(?:{quoted}|[^"{sep}][^{sep}]*+|){sep})*+'
        self.opens = f'^{cells}"{inside}$'  # no cell open at the start, one at the end
        self.stays = f"^{inside}$"  # open at the start, still open at the end
        self.reopens = f'^{inside}"[^{sep}]*+{sep}{cells}"{inside}$'
        self.quoted = f'"{inside}"'
        self.separator = sep

    def count(self, record: Column) -> Column:
        """How many cells a record has."""
        plain = F.regexp_replace(record, self.quoted, "")
        return F.length(plain) - F.length(F.regexp_replace(plain, self.separator, "")) + 1


def _composed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``fixed`` and ``flips``: what the rows up to each one make of the state at the start of ``keys``.

    A row gives a state of its own (``to`` not null) or keeps or flips the state (``flip``). The state after a
    row is ``fixed`` if that is not null, else the state at the start, flipped ``flips`` times.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum("flip").over(upto))
    last = summed.withColumn("_at", F.last(F.when(F.col("to").isNotNull(), F.struct("to", "_sum")), ignorenulls=True).over(upto))
    fixed = (F.col("_at.to") + F.col("_sum") - F.col("_at._sum")) % 2
    return last.withColumn("fixed", fixed).withColumn("flips", F.col("_sum")).drop("_sum", "_at")


def read_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(file, block, at, line)``: the lines of a file or folder, in order of the three first columns.

    Lines end at the byte of a line feed, so ``encoding`` is one in which that byte means nothing else.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), line.alias("line"))


def join_records(lines: DataFrame, separator: str = ",") -> DataFrame:
    """``(file, block, at, record)``: lines joined to records where a quoted cell holds line breaks. A record has the
    place of its first line."""
    cells = _Cells(separator)
    line = F.col("line")
    opened, kept = line.rlike(cells.opens), line.rlike(cells.stays) | line.rlike(cells.reopens)
    if lines.filter(opened).isEmpty():
        return lines.withColumnRenamed("line", "record")
    marked = lines.withColumn("to", F.when(opened == kept, opened.cast("int"))).withColumn("flip", (opened & ~kept).cast("int"))
    marked = materialize(_composed(marked, ["file", "block"], "at"), "lines")
    blocks = marked.groupBy("file", "block").agg(F.max_by(F.struct(F.col("fixed").alias("to"), (F.col("flips") % 2).alias("flip")), "at").alias("f"))
    along = Window.partitionBy("file").orderBy("block")
    state = F.coalesce("fixed", F.col("flips") % 2)  # a file starts outside any cell
    blocks = _composed(blocks.select("file", "block", "f.*"), ["file"], "block")
    blocks = blocks.select("file", "block", F.coalesce(F.lag(state).over(along), F.lit(0)).alias("start"))
    known = marked.join(materialize(blocks, "blocks"), ["file", "block"])
    after = F.coalesce("fixed", (F.col("start") + F.col("flips")) % 2)
    within = Window.partitionBy("file", "block").orderBy("at")
    begins = F.coalesce(F.lag(after).over(within), F.col("start")) == 0
    first = F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(within)
    placed = known.withColumn("begins", begins).select("file", "block", "at", "line", first.alias("first"))
    placed = materialize(placed, "placed")
    # Lines before the first record of a block belong to the last record of the blocks before it.
    lasts = placed.groupBy("file", "block").agg(F.max("first").alias("last"))
    before = F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("at"))), ignorenulls=True)
    carried = lasts.select("file", "block", before.over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owner = F.coalesce(F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("at"))), F.col("carried"))
    owned = placed.join(materialize(carried, "carried"), ["file", "block"]).withColumn("owner", owner)
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "line")))
    joined = owned.groupBy("file", "owner").agg(parts.alias("parts"))
    whole = F.when(F.size("parts") <= RECORD_LINES, F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).otherwise(
        F.raise_error(F.concat(F.lit("a quoted cell is never closed in "), F.col("file"))))
    return joined.select("file", "owner.block", "owner.at", whole.alias("record"))


def _records(spark: SparkSession, path: str, fmt: SourceFormat, separator: str) -> DataFrame:
    found = join_records(read_lines(spark, path, fmt.encoding), separator)
    clean = F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r$", "")
    return found.withColumn("record", clean).filter(F.trim("record") != "")


def _parsed(records: DataFrame, columns: Sequence[str], separator: str) -> DataFrame:
    """The cells of each record by name, beside its place; missing and empty cells are null."""
    # The schema as text: names of any kind stay whole.
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "multiLine": "true"}
    return records.withColumn("cells", F.from_csv("record", schema, options))


def _headed(spark: SparkSession, path: str, fmt: SourceFormat, separator: str) -> tuple[DataFrame, list[str]]:
    """Records after the header line of each file, and the names in it."""
    records = _records(spark, path, fmt, separator)
    places = ["file", "block", "at"]
    heads = records.groupBy("file").agg(F.min(F.struct("block", "at", "record")).alias("head"))
    names = [r["head"]["record"] for r in heads.orderBy("file").collect()]
    if not names:
        raise ValueError(f"{path} has no header")
    if len(set(names)) > 1:
        raise ValueError(f"the files of {path} differ in their headers")
    tops = F.broadcast(heads.select("file", "head.block", "head.at"))  # a row per file
    return records.join(tops, places, "left_anti"), next(csv.reader([names[0]], delimiter=separator))


def read_headed(spark: SparkSession, path: str, columns: Sequence[str], fmt: SourceFormat = SourceFormat()) -> DataFrame:
    """Read a file with a header line and keep ``columns`` (found by name)."""
    records, names = _headed(spark, path, fmt, fmt.separator)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return _parsed(records, names, fmt.separator).select(*[F.col("cells")[c].alias(c) for c in columns])


def read_headerless(spark: SparkSession, path: str, columns: Sequence[str], fmt: SourceFormat) -> DataFrame:
    """Read a file without header: short lines are padded, over-long lines skipped, even if their extra cells are empty."""
    records = _records(spark, path, fmt, fmt.separator)
    if fmt.skip_long_lines:
        records = records.filter(_Cells(fmt.separator).count(F.col("record")) <= len(columns))
    return _parsed(records, columns, fmt.separator).select(*[F.col("cells")[c].alias(c) for c in columns])


def read_records(spark: SparkSession, path: str, config: MatchConfig) -> DataFrame:
    columns = ["id", *config.columns]
    if config.source.header:
        return read_headed(spark, path, columns, config.source)
    return read_headerless(spark, path, columns, config.source)


def read_truth(spark: SparkSession, path: str, config: MatchConfig) -> DataFrame:
    """Read the truth file as ``(a_id, b_id, row_order)``; an empty cell stays an empty
    string. ``row_order`` grows along the file, and from file to file by name, and decides which row is the last."""
    left, right = config.truth_columns
    separator = config.source.truth_separator
    records, names = _headed(spark, path, config.source, separator)
    missing = [c for c in (left, right) if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    cells = _parsed(records, names, separator)
    return cells.select(
        F.coalesce(F.col("cells")[left], F.lit("")).alias("a_id"),
        F.coalesce(F.col("cells")[right], F.lit("")).alias("b_id"),
        F.struct("file", "block", "at").alias("row_order"),
    )
