"""Byte-level BPE in numpy: padded matrices by length, one leftmost minimum-rank merge per row and round.

The distinct pieces of a batch (matches of the splitting pattern) are sorted into buckets
of similar length. A bucket is a padded matrix of token ids beside a matrix of the ranks
of neighbouring pairs; each round merges the leftmost pair of least rank in every row,
compacts the row, looks up its two new pairs in a hash table, and lets finished rows go.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, mix

NONE = np.int32(2**31 - 1)
#: Bucket bounds in bytes; a longer piece (in running text there is none) is merged by itself, with a heap,
#: since a matrix row costs the square of its length.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 512)
#: Characters encoded at once, and distinct pieces a worker remembers.
BATCH_CHARS = 4_000_000
REMEMBERED = 400_000


class Ranks:
    """A rank file: token bytes by id, and the rank of every pair of tokens that merges into a token."""

    def __init__(self, path: str) -> None:
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token)] = int(rank)
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.fromiter((len(t) for t in tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, merged in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(merged)
        self._fill(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))

    def _fill(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        keys = (left << 32) | right
        self.mask = np.int64((1 << int(np.ceil(np.log2(4 * max(1, len(keys)))))) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.ranks = np.full(int(self.mask) + 1, NONE, np.int32)
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[waiting[free]]  # of several claims one is written
            placed = self.keys[at] == keys[waiting]
            self.ranks[at[placed]] = rank[waiting[placed]]
            waiting = waiting[~placed]
            slots[waiting] = (slots[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE if it does not merge or one side is padding (-1)."""
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2  # no such key is stored
        slots = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        waiting = np.arange(len(keys))
        while len(waiting):
            found = self.keys[slots[waiting]]
            same = found == keys[waiting]
            out[waiting[same]] = self.ranks[slots[waiting[same]]]
            waiting = waiting[~same & (found != -1)]
            slots[waiting] = (slots[waiting] + 1) & self.mask
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        open_ = np.ones(len(pieces), bool)
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i], open_[i] = np.array([whole], np.int32), False
        above = 0
        for bound in BUCKETS:
            rows = np.flatnonzero(open_ & (lengths > above) & (lengths <= bound))
            above = bound
            for part in np.array_split(rows, max(1, len(rows) * bound // 4_000_000)):
                if len(part):
                    self._merge([pieces[i] for i in part], part, out)
        for i in np.flatnonzero(open_ & (lengths > above)):
            out[i] = self._merge_long(pieces[i])
        counts = np.fromiter((0 if o is None else len(o) for o in out), np.int64, len(out))
        filled = [o for o in out if o is not None]
        return (np.concatenate(filled) if filled else np.empty(0, np.int32)), counts

    def _merge(self, pieces: list[bytes], places: np.ndarray, out: list[np.ndarray | None]) -> None:
        widths = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        width = int(widths.max())
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < widths[:, None], self.of_byte[data], np.int32(-1))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(ids):
            width = ids.shape[1]
            place = ranks.argmin(1) if width > 1 else np.zeros(len(ids), np.int64)  # the leftmost of equals
            rows = np.arange(len(ids))
            best = ranks[rows, place] if width > 1 else np.full(len(ids), NONE)
            done = best == NONE
            for row in np.flatnonzero(done):
                out[places[row]] = ids[row, : widths[row]]
            ids, ranks, places, widths = ids[~done], ranks[~done], places[~done], widths[~done]
            if not len(ids):
                return
            place, best, rows = place[~done], best[~done], np.arange(len(ids))
            ids[rows, place] = best
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > place[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= place[:, None]), 1)
            widths = widths - 1
            before = np.flatnonzero(place > 0)
            ranks[before, place[before] - 1] = self.pair_ranks(ids[before, place[before] - 1], ids[before, place[before]])
            after = np.flatnonzero(place < width - 2)
            ranks[after, place[after]] = self.pair_ranks(ids[after, place[after]], ids[after, place[after] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long piece: a heap of (rank, place) over linked tokens."""
        ids = [int(self.of_byte[b]) for b in piece]
        ahead, behind = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        tokens = [bytes([b]) for b in piece]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and ahead[i] < len(ids):
                rank = self.ids.get(tokens[i] + tokens[ahead[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(tokens[i]), len(tokens[ahead[i]])))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, own, other = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] < 0 or j >= len(ids) or len(tokens[i]) != own or len(tokens[j]) != other:
                continue  # one of the two has been merged meanwhile
            tokens[i] += tokens[j]
            ids[i], ids[j] = rank, -1
            ahead[i] = ahead[j]
            if ahead[j] < len(ids):
                behind[ahead[j]] = i
            offer(behind[i])
            offer(i)
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as one array."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


class Codes(dict):
    """Strings by number, in order of appearance."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Encodes batches of texts, remembering pieces it has met."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        known, code = len(self.codes), self.codes.__getitem__
        per_text = []
        for text in texts:
            pieces = self.pattern.findall(text)
            per_text.append(np.fromiter(map(code, pieces), np.int64, len(pieces)))
        new = list(islice(self.codes, known, None))
        ids, counts = self.ranks.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        flat = np.concatenate(per_text) if per_text else np.empty(0, np.int64)
        lengths = self.counts[flat]
        sizes = np.fromiter((len(p) for p in per_text), np.int64, len(per_text))
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(sizes)]
        return self.ids[ragged(starts[flat], lengths)], np.diff(ends, prepend=0)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row.

    Ids equal those of the rank file at ``path`` applied to each match of ``pattern``; special
    tokens have no meaning. ``decoded_sha256`` is of the bytes that the ids decode to. Null
    and empty texts have no ids; null ids and repeated rows are rows like any other; texts
    of any length are encoded whole; an empty table gives no rows; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(load_ranks(path), pattern)
        for frame in frames:
            texts = frame.body.fillna("")
            for part in batches(texts.str.len().to_numpy(), BATCH_CHARS):
                ids, counts = encoder.encode(texts.iloc[part].tolist())
                raw, decoded = ids.astype("<u4"), encoder.ranks.decode(ids)
                ends = np.cumsum(counts)
                stops = np.r_[0, np.cumsum(encoder.ranks.lengths[ids])]
                spans = list(zip(ends - counts, ends))
                made = {
                    "doc_id": frame.doc_id.iloc[part].array,
                    "n_tokens": counts,
                    "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans],
                    "decoded_sha256": [hashlib.sha256(decoded[stops[a] : stops[b]]).hexdigest() for a, b in spans],
                }
                if with_ids:
                    made["ids"] = [ids[a:b] for a, b in spans]
                yield pd.DataFrame(made)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInPandas(run, schema)
