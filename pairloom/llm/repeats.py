"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of ``width`` bytes over it (a window) also starts anywhere
else. The corpus is never one text to one task: windows are dealt by their minimizer, the
least hash among their short grams, so equal windows always meet. A run of consecutive windows
with one minimizer travels as one piece of text. Equal pieces are counted, not compared;
different pieces under one minimizer come to one task, where the transforms of shards of
pieces are built and merged (``bwt``), and the windows found twice are marked. Pieces whose
minimizer occurs nowhere else are never moved.

A minimizer with very many different pieces (a passage in every second document, say) is
taken apart: its windows are counted one by one under their hashes, in as many tasks as it takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import ragged
from pairloom.llm.bwt import repeated_rows
from pairloom.llm.common import batches, mix
from pairloom.session import materialize

WIDTH = 400
#: Bytes of a gram; at most the width.
GRAM = 32
#: Bytes of text cut into pieces at once, of pieces merged at once, and of one shard of those.
BATCH_BYTES = 2_000_000
MERGE_BYTES = 1_500_000
SHARD_BYTES = 1 << 18
#: Different pieces under a minimizer that are still merged in one task.
MERGED_PIECES = 2048

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of substrings of one array of bytes, from sums of its prefixes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])
            self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])]

    def windows(self, width: int) -> np.ndarray:
        """The hash of every substring of ``width`` bytes."""
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each substring, its length mixed in."""
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def cut_pieces(texts: list[bytes], width: int, gram: int) -> pd.DataFrame:
    """(text, start, windows, minimizer, twice): runs of windows with one minimizer, at most ``width`` windows each.

    ``twice``: whether the minimizer's gram occurs again in the piece, as it must if two of its windows are equal.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    columns = ["text", "start", "windows", "minimizer", "twice"]
    if len(data) < width:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in columns}).astype({"twice": bool})
    grams = Rolling(data).windows(gram)
    least = sliding_minimum(grams, width - gram + 1)
    ends = np.cumsum(sizes)
    many = np.maximum(sizes - width + 1, 0)
    at = ragged(ends - sizes, many)
    text = np.repeat(np.arange(len(texts)), many)
    key = least[at]
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(at)]
    runs = np.flatnonzero(new)
    lengths = np.diff(np.r_[runs, len(at)])
    cuts = -(-lengths // width)
    place = ragged(np.zeros(len(runs), np.int64), cuts) * width
    first = np.repeat(runs, cuts) + place
    windows = np.minimum(np.repeat(lengths, cuts) - place, width)
    spans = windows + width - gram
    same = grams[ragged(at[first], spans)] == np.repeat(key[first], spans)
    seen = np.add.reduceat(same, np.cumsum(spans) - spans, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    return pd.DataFrame({
        "text": text[first], "start": at[first] - (ends - sizes)[text[first]], "windows": windows,
        "minimizer": key[first].view(np.int64), "twice": seen > 1,
    })


def _byte_batches(bodies: pd.Series) -> Iterator[tuple[slice, list[bytes]]]:
    for part in batches(bodies.str.len().to_numpy(), BATCH_BYTES):
        yield part, [bytes(b) for b in bodies.iloc[part]]


def _pieces(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(minimizer, piece, uid, start, windows, twice, n) of all texts; ``piece`` is the digest of its bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, bodies in _byte_batches(frame.body):
                cut = cut_pieces(bodies, width, gram)
                spans = zip(cut.text, cut.start, cut.start + cut.windows + (width - 1))
                cut["piece"] = [hashlib.blake2b(bodies[t][a:b], digest_size=16).digest() for t, a, b in spans]
                cut["uid"], cut["n"] = frame.uid.iloc[part].to_numpy()[cut.text], frame.n.iloc[part].to_numpy()[cut.text]
                yield cut.drop(columns="text")

    schema = "start long, windows int, minimizer long, twice boolean, piece binary, uid long, n long"
    return texts.select("uid", F.encode("body", "UTF-8").alias("body"), "n").mapInPandas(run, schema)


def _bodies(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (minimizer, piece, uid, start, windows) with the bytes of each piece."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("minimizer", "piece", "start", "windows")).alias("places"))
    joined = texts.select("uid", F.encode("body", "UTF-8").alias("body")).join(materialize(lists, "places"), "uid")
    place = F.explode("places").alias("p")
    return joined.select("uid", "body", place).select(
        "p.minimizer", "p.piece", "uid", "p.start", "p.windows",
        F.substring(F.col("body"), (F.col("p.start") + 1).cast("int"), F.col("p.windows") + (width - 1)).alias("bytes"))


RANGES = "uid long, first long, last long"


def _ranges(uid: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """(uid, first, last): consecutive starts of windows as ranges; sorted by uid and start."""
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (uid[1:] != uid[:-1])][: len(start)]
    first = np.flatnonzero(new)
    return pd.DataFrame({"uid": uid[first], "first": start[first], "last": start[np.r_[first[1:], len(start)][: len(first)] - 1]})


def _merged(pieces: DataFrame, width: int) -> DataFrame:
    """Ranges of windows that occur twice among the pieces of a minimizer."""

    def marked(held: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(held, ignore_index=True)
        string, offset = repeated_rows([bytes(b) for b in frame.bytes], width, SHARD_BYTES)
        found = _ranges(string, offset)
        start = frame.start.to_numpy()[found.uid]
        return pd.DataFrame({"uid": frame.uid.to_numpy()[found.uid], "first": start + found["first"], "last": start + found["last"]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            changes = np.flatnonzero(np.r_[True, np.diff(frame.minimizer.to_numpy()) != 0][: len(frame)]).tolist()
            for start, end in zip(changes, [*changes[1:], len(frame)]):
                part = frame.iloc[start:end]
                if size > MERGE_BYTES and held[-1].minimizer.iloc[0] != part.minimizer.iloc[0]:
                    yield marked(held)
                    held, size = [], 0
                held.append(part)
                size += int(part.bytes.str.len().sum())
        if held:
            yield marked(held)

    dealt = pieces.select("minimizer", "uid", "start", "bytes").repartition("minimizer").sortWithinPartitions("minimizer")
    return dealt.mapInPandas(run, RANGES)


def _window_hashes(pieces: DataFrame, width: int) -> DataFrame:
    """(minimizer, hash, uid, start, n) of every window of the pieces, its starts within one text as a list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, bodies in _byte_batches(frame.bytes):
                sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
                hashes = Rolling(np.frombuffer(b"".join(bodies), np.uint8)).windows(width)
                many = sizes - width + 1
                at = ragged(np.cumsum(sizes) - sizes, many)
                own = frame.iloc[part]
                yield pd.DataFrame({
                    "minimizer": np.repeat(own.minimizer.to_numpy(), many), "hash": hashes[at].view(np.int64),
                    "uid": np.repeat(own.uid.to_numpy(), many),
                    "start": ragged(own.start.to_numpy(), many), "n": np.repeat(own.n.to_numpy(), many),
                })

    schema = "minimizer long, hash long, uid long, start long, n long"
    return pieces.select("minimizer", "uid", "start", "bytes", "n").mapInPandas(run, schema)


def _taken_apart(pieces: DataFrame, width: int) -> DataFrame:
    """Ranges of windows of hot minimizers that occur twice, each window counted under its hash."""
    windows = _window_hashes(pieces, width)
    twice = windows.groupBy("minimizer", "hash").agg(F.sum("n").alias("n")).filter("n > 1")
    marked = windows.drop("n").join(materialize(twice.drop("n"), "hot-windows"), ["minimizer", "hash"], "left_semi")
    return marked.select("uid", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_windows(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, merged_pieces: int = MERGED_PIECES) -> DataFrame:
    """(uid, first, last): starts of windows that occur at least twice, for stored ``texts`` (uid, body, n)."""
    cut = materialize(_pieces(texts, width, gram), "pieces")
    often = materialize(cut.groupBy("minimizer").agg(F.sum("n").alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("minimizer"), "often")
    cut = materialize(cut.join(often, "minimizer", "left_semi"), "often-pieces")
    kinds = cut.groupBy("minimizer", "piece").agg(
        F.sum("n").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("uid", "start", "windows")).alias("one"))
    kinds = materialize(kinds.select("minimizer", "piece", "n", "twice", "one.*"), "kinds")
    copies = materialize(kinds.filter("n > 1").select("minimizer", "piece"), "copied-pieces")
    whole = cut.join(copies, ["minimizer", "piece"], "left_semi").select("uid", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))
    # What the copies leave open: pieces that occur once, beside any other piece of their minimizer.
    open_ = kinds.groupBy("minimizer").agg(
        F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("n") == 1, 1)).alias("single"), F.max(F.col("twice") & (F.col("n") == 1)).alias("twice"))
    open_ = materialize(open_.filter("single > 0 and (pieces > 1 or twice)").select("minimizer", (F.col("pieces") > merged_pieces).alias("hot")), "open")
    wanted = materialize(kinds.select("minimizer", "piece", "uid", "start", "windows", "n").join(open_, "minimizer"), "wanted")
    bodies = materialize(_bodies(texts, wanted.select("minimizer", "piece", "uid", "start", "windows"), width), "piece-bytes")
    merged = _merged(_of(bodies, wanted, hot=False), width)
    apart = _taken_apart(_of(bodies, wanted, hot=True), width)
    return whole.unionByName(merged).unionByName(apart)


def _of(bodies: DataFrame, wanted: DataFrame, hot: bool) -> DataFrame:
    chosen = wanted.filter("hot" if hot else "not hot")
    return bodies.join(chosen.select("minimizer", "piece", "n"), ["minimizer", "piece"])


def _cut_out(texts: DataFrame, windows: DataFrame, width: int, with_text: bool) -> DataFrame:
    """(uid, n_removed, n_spans, kept_sha256[, spans, kept]) of the texts that lose bytes."""
    columns = ["uid", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uid, body, ranges in zip(frame.uid, frame.body, frame.ranges):
                body, spans = bytes(body), []
                for first, last in sorted((r["first"], r["last"]) for r in ranges):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + width)
                    else:
                        spans.append([first, last + width])
                edges = [0, *(e for s in spans for e in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (uid, len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, spans, kept) if with_text else row)
            yield pd.DataFrame(rows, columns=columns)

    lists = windows.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = texts.select("uid", F.encode("body", "UTF-8").alias("body")).join(materialize(lists, "ranges"), "uid")
    schema = "uid long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_text
    return joined.mapInPandas(run, schema)


def distinct_texts(docs: DataFrame, text: Column, width: int) -> DataFrame:
    """Stored texts of at least ``width`` bytes, each once: (key, body, n, uid)."""
    long = docs.select(_key(text).alias("key"), text.alias("body")).filter(F.octet_length("body") >= width)
    once = long.groupBy("key").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    return materialize(once.withColumn("uid", F.monotonically_increasing_id()), "texts")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
    merged_pieces: int = MERGED_PIECES, with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) for every row.

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents. Every byte under a
    string of ``width`` bytes that also starts elsewhere (in the same document, too) is removed;
    all are judged on the input, so a passage loses its first occurrence as well. Equal
    texts of at least ``width`` bytes lose everything. Shorter texts lose nothing. ``spans``
    are the maximal removed runs, ``kept`` the bytes that remain. Repeated rows and null ids
    are rows like any other; other columns are ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = distinct_texts(docs, body, width)
    found = _cut_out(texts, repeated_windows(texts, width, gram, merged_pieces), width, with_text)
    found = materialize(texts.select("uid", "key").join(found, "uid").drop("uid"), "cut-out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), _key(F.col("body")).alias("key"),
        F.sha2(F.col("body").cast("binary"), 256).alias("whole"), *[F.col("body").cast("binary").alias("body")] * with_text)
    joined = rows.join(found, "key", "left")
    columns = [
        "doc_id", "n_bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    if with_text:
        columns += [F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("kept", "body").alias("kept")]
    return joined.select(*columns)
