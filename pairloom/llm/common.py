"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text (runs of anything but white space), in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def partitions_for(rows: int, each: int) -> int:
    """As many partitions as keep about ``each`` rows in one."""
    return max(1, -(-rows // each))


def batches(lengths: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` characters; one row is never cut."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield slice(start, len(lengths))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash can be used on its own."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (A-Z lowered), and how many words each text has.

    Works on the joined UTF-8 bytes: a word's hash is a polynomial over its bytes,
    summed by segments, then mixed.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) for b in raw), np.int64, len(raw))
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)] if raw else np.empty(0, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    space = _SPACE[data]
    inside = ~space
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(space & before)
    lengths = ends - starts
    text_ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
        hashes = np.add.reduceat(terms, firsts)
    return mix(hashes), counts
