"""Packing by lexical retrieval: windows filled with the BM25 neighbours of a seed document.

Documents are cut at the window length; whole windows stand for themselves and only the
remainders (tails) are packed. Tails are dealt by their most characteristic terms to
shards of bounded size, so that related ones meet. Each shard has an inverted index with
BM25 weights (document frequencies and mean length over all tails). The first unused tail
is the seed; its unused neighbours fill the window in order of score, and the best one
that does not fit is cut, its rest staying in the index. So only the last window of a
shard has room left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import BATCH_CHARS
from pairloom.llm.common import batches, partitions_for
from pairloom.llm.words import load_encoder
from pairloom.session import materialize

WINDOW = 1024
END = 0
#: Tails in one index shard.
SHARD = 2048
#: Terms of the seed that are looked up, by weight.
QUERY_TERMS = 32
#: Ids whose terms are counted at once.
BATCH_TERMS = 1_000_000
K1, B = 1.2, 0.75
#: Terms by which a tail is dealt to a shard.
ROUTE_TERMS = 2

PACKED = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, window: int) -> DataFrame:
    """Stored pieces: whole windows with their sequence, and tails (``ids`` not null) without one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(path, pattern)
        sequence = TaskContext.get().partitionId() << 33
        for frame in frames:
            texts = frame.body.fillna("")
            for part in batches(texts.str.len().to_numpy(), BATCH_CHARS):
                ids, counts = encoder.encode(texts.iloc[part].tolist())
                rows = []
                end = 0
                for name, n in zip(frame.doc_id.iloc[part], counts):
                    own = np.append(ids[end : end + n], END).astype(np.int32)
                    end += n
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        if len(piece) == window:
                            rows.append((name, start, window, _crc(piece), len(own), sequence, None))
                            sequence += 2  # even numbers; packed sequences have odd ones
                        else:
                            rows.append((name, start, len(piece), None, len(own), None, piece.tobytes()))
                made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids"])
                yield made.astype({"ids_crc32": "Int64", "sequence_id": "Int64"})

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary"
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).mapInPandas(run, schema), "pieces")


def term_counts(tails: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, term, times) of the distinct terms of each tail, sorted by tail and term."""
    arrays = [np.frombuffer(ids, np.int32) for ids in tails]
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    keys, times = np.unique((owner << 32) | np.concatenate([*arrays, np.empty(0, np.int32)]), return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, times


def term_statistics(tails: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of every token id over all tails, their number and mean length; as large as the vocabulary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for frame in frames:
            for ids in map(frame.ids.iloc.__getitem__, batches(frame.length.to_numpy(), BATCH_TERMS)):
                own = np.bincount(term_counts(ids)[1])
                seen = np.pad(seen, (0, max(0, len(own) - len(seen))))
                seen[: len(own)] += own
        terms = np.flatnonzero(seen)
        yield pd.DataFrame({"term": terms, "n": seen[terms]})

    counted = tails.select("ids", "length").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n, length = tails.agg(F.count(F.lit(1)), F.avg("length")).first()
    frequencies = np.zeros(1 + max((r.term for r in counted), default=0), np.int64)
    for row in counted:
        frequencies[row.term] = row.n
    return frequencies, n, length or 1.0


def idf_of(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - frequencies + 0.5) / (frequencies + 0.5))


def route_tails(tails: DataFrame, idf: np.ndarray, n: int) -> DataFrame:
    """Tails ordered within range partitions by their heaviest terms; equal terms are split by a number of the row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame.length.to_numpy(), BATCH_TERMS):
                piece = frame.iloc[part]
                tail, term, times = term_counts(piece.ids)
                order = np.lexsort((term, -times * idf[term], tail))
                tail, term = tail[order], term[order]
                place = np.arange(len(tail)) - np.searchsorted(tail, tail)
                routes = np.full((len(piece), ROUTE_TERMS), -1)
                top = place < ROUTE_TERMS
                routes[tail[top], place[top]] = term[top]
                yield piece.assign(route=list(routes))

    fields = {f.name: f.dataType.simpleString() for f in tails.schema.fields}
    schema = ", ".join(f"{k} {v}" for k, v in fields.items()) + ", route array<int>"
    # Stored, since range partitioning reads it twice: once for the bounds.
    routed = materialize(tails.mapInPandas(run, schema), "routed")
    return routed.repartitionByRange(partitions_for(n, SHARD), "route", "uid").sortWithinPartitions("route", "uid")


class Shard:
    """An inverted index with BM25 weights over the tails of one shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.tails = tails
        lengths = np.array([len(t) for t in tails], float)
        docs = np.repeat(np.arange(len(tails)), [len(t) for t in tails])
        keys, times = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + docs, return_counts=True)
        self.terms, self.docs = keys // len(tails), keys % len(tails)
        norm = K1 * (1 - B + B * lengths[self.docs] / mean_length)
        self.weights = idf[self.terms] * times * (K1 + 1) / (times + norm)
        by_doc = np.argsort(self.docs, kind="stable")
        self.of_doc = np.split(by_doc, np.cumsum(np.bincount(self.docs, minlength=len(tails)))[:-1])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share a looked-up term with the seed, best first (ties: in order)."""
        own = self.of_doc[seed]
        top = own[np.argsort(-self.weights[own], kind="stable")[:QUERY_TERMS]]
        scores = np.zeros(len(self.tails))
        terms = self.terms[top]
        for first, last in zip(np.searchsorted(self.terms, terms).tolist(), np.searchsorted(self.terms, terms, "right").tolist()):
            scores[self.docs[first:last]] += self.weights[first:last]
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, first id, ids): every id of every tail in one place, all windows full but the last."""
    shard = Shard(tails, idf, mean_length)
    sizes = np.array([len(t) for t in tails])
    used = np.zeros(len(tails), np.int64)
    seed, windows = 0, []
    while True:
        while seed < len(tails) and used[seed] == sizes[seed]:
            seed += 1
        if seed == len(tails):
            return windows
        room, parts = window, []

        def take(tail: int, most: int) -> int:
            n = min(int(sizes[tail] - used[tail]), most)
            parts.append((tail, int(used[tail]), n))
            used[tail] += n
            return most - n

        room = take(seed, room)
        if room:
            unused = used < sizes
            near = shard.neighbours(seed, unused)
            fitting = near
            while len(fitting := fitting[sizes[fitting] - used[fitting] <= room]) and room:
                room = take(int(fitting[0]), room)
                fitting = fitting[1:]
            rest = near if room else ()
            for tail in [*rest, *(np.flatnonzero(unused) if room else ())]:
                if not room:
                    break
                if used[tail] < sizes[tail]:
                    room = take(int(tail), room)
        windows.append(parts)


def pack_documents(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    A document is its ids by the tokenizer file at ``path`` and an end id; null texts are
    empty and hold the end id alone. Every id lies in exactly one piece; pieces of a
    sequence follow each other without gaps. Null ids and repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut_documents(docs, path, pattern, doc_id, text, window)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    whole = pieces.where("ids is null").select(*columns, F.lit(0).cast("long").alias("offset"))
    tails = pieces.where("ids is not null").select("doc_id", "start", "length", "doc_tokens", "ids").withColumn(
        "uid", F.monotonically_increasing_id()
    )
    frequencies, n, mean_length = term_statistics(tails)
    idf = idf_of(frequencies, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = (TaskContext.get().partitionId() << 33) + 1
        held: list[pd.DataFrame] = []

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal sequence
            tails = [np.frombuffer(ids, np.int32) for ids in rows.ids]
            out = []
            for parts in pack_shard(tails, idf, mean_length, window):
                offset = 0
                for tail, first, size in parts:
                    crc = _crc(tails[tail][first : first + size])
                    out.append((tail, first, size, crc, sequence, offset))
                    offset += size
                sequence += 2
            place = [p[0] for p in out]
            return pd.DataFrame(
                {
                    "doc_id": rows.doc_id.iloc[place].array,
                    "start": rows.start.to_numpy()[place] + np.array([p[1] for p in out]),
                    "length": [p[2] for p in out],
                    "ids_crc32": [p[3] for p in out],
                    "doc_tokens": rows.doc_tokens.to_numpy()[place],
                    "sequence_id": [p[4] for p in out],
                    "offset": [p[5] for p in out],
                }
            )

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= SHARD:
                rows = pd.concat(held)
                while len(rows) >= SHARD:
                    yield packed(rows.iloc[:SHARD])
                    rows = rows.iloc[SHARD:]
                held = [rows]
        if sum(map(len, held)):
            yield packed(pd.concat(held))

    kind = docs.schema[doc_id].dataType.simpleString()
    filled = route_tails(tails, idf, n).mapInPandas(run, PACKED.format(id=kind))
    return whole.unionByName(filled)
