"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes, so a token is a byte range. Within a batch one
``merge_asof`` per direction, keyed by document, finds for each token start the other
side's covering token; the union of both directions is every pair of ranges that
overlap. Offsets at which both sides end a token cut them into groups.

Linked pairs of ids are counted over the whole corpus: each task sums its own documents,
Spark sums the tasks. The counts go back to the documents as a broadcast table while
they are few, and by a join on the pair otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.bpe import Encoder, Ranks, ragged
from pairloom.llm.common import batches
from pairloom.session import materialize

#: Characters aligned at once.
BATCH_CHARS = 1_000_000
#: Pairs of ids a task sums before it hands them on.
SUMMED = 1 << 20
#: Most pairs of ids that are broadcast (20 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters() -> dict[str, int]:
    """The byte for each printable letter of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(moved)): b for b in range(256)}


class ByteLevel(Ranks):
    """The merges of a byte-level tokenizer file, for the padded matrices of ``bpe``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        spelt = {token: bytes(map(letters.__getitem__, token)) for token in model["vocab"] if all(c in letters for c in token)}
        self.size = max(model["vocab"].values()) + 1
        tokens = [b""] * self.size
        for token, written in spelt.items():
            tokens[model["vocab"][token]] = written
        self.set_tokens(tokens)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array([model["vocab"][t] for t in side], np.int64) for side in (
            [a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        if np.any(np.diff(merged) <= 0):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.of_byte = np.array([model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        self.ids = {}  # a whole piece is merged like any other
        self._fill(left, right, merged.astype(np.int32))
        self._library = Tokenizer.from_file(path).model
        self._letters = {b: c for c, b in letters.items()}

    def set_tokens(self, tokens: list[bytes]) -> None:
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        found = self._library.tokenize(piece.decode("latin-1").translate(self._letters))
        return np.array([t.id for t in found], np.int32)


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes each id stands for."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        tokens = [_piece_bytes(self.model.id_to_piece(i)) for i in range(self.size)]
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.empty(int(counts.sum()), np.int32)
        end = 0
        for own in found:
            ids[end : end + len(own)] = own
            end += len(own)
        return ids, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def load_byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(doc, a, b): all pairs of tokens whose byte ranges meet.

    ``a`` and ``b`` have (doc, start) sorted by start, both gapless within a document. A
    pair that begins at one byte is found from both sides and counts once.
    """
    a, b = a[["doc", "start"]].assign(a=np.arange(len(a))), b[["doc", "start"]].assign(b=np.arange(len(b)))
    over_b = pd.merge_asof(b, a, on="start", by="doc")
    over_a = pd.merge_asof(a, b.assign(begins=b.start), on="start", by="doc")
    return pd.concat([over_b, over_a[over_a.begins != over_a.start]])[["doc", "a", "b"]].astype({"a": "int64", "b": "int64"})


def _same_bytes(tokens, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which documents' tokens spell their bytes."""
    made = tokens.decode(ids)
    ends = np.cumsum(counts)
    lengths = np.diff(np.r_[0, np.cumsum(tokens.lengths[ids])][np.r_[0, ends]])
    if np.array_equal(lengths, sizes) and np.array_equal(made, raw):
        return np.ones(len(sizes), bool)
    at, its = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(lengths)]
    same = lengths == sizes
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(raw[at[i] : at[i + 1]], made[its[i] : its[i + 1]])
    return same


class Aligner:
    """Aligns batches of texts; remembers the pieces of side A it has met."""

    def __init__(self, path_a: str, pattern: str, path_b: str) -> None:
        self.a, self.b = load_byte_level(path_a), load_pieces(path_b)
        self.encoder = Encoder(self.a, pattern)
        comma, bar, semi = ([f"{i}{end}" for i in range(max(self.a.size, self.b.size))] for end in ",|;")
        self.written = {c: np.array(x, object) for c, x in zip(",|;", (comma, bar, semi))}

    def tokens(self, texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Tokens of both sides as (doc, start, end, id); offsets run on from text to text."""
        present = [i for i, t in enumerate(texts) if t]
        spelt = [" " + texts[i] for i in present]
        raw = [t.encode("utf-8", "surrogatepass") for t in spelt]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sides = [(self.a, *self.encoder.encode(spelt)), (self.b, *self.b.encode([texts[i] for i in present]))]
        good = np.ones(len(present), bool)
        for tokens, ids, counts in sides:
            good &= _same_bytes(tokens, ids, counts, data, sizes)
        frames = []
        for tokens, ids, counts in sides:
            kept = np.repeat(good, counts)
            doc, own = np.repeat(np.array(present, np.int64), counts)[kept], ids[kept]
            end = np.cumsum(tokens.lengths[own])
            frames.append(pd.DataFrame({"doc": doc, "start": end - tokens.lengths[own], "end": end, "id": own}))
        return frames[0], frames[1]

    def align(self, texts: list[str]) -> tuple[pd.DataFrame, list[np.ndarray], list[np.ndarray]]:
        """Counts and group digest of each text; and its linked pairs (a * size of B + b) with how often."""
        a, b = self.tokens(texts)
        met = overlaps(a, b)
        left, right = met.a.to_numpy(), met.b.to_numpy()
        linked = a.end.to_numpy()[left] == b.end.to_numpy()[right]
        left, right = left[linked], right[linked]
        n = len(texts)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[left], last_b[right] = True, True
        made = pd.DataFrame({
            "n_a": np.bincount(a.doc, minlength=n), "n_b": np.bincount(b.doc, minlength=n),
            "n_groups": np.bincount(a.doc.to_numpy()[last_a], minlength=n),
            "n_links": np.bincount(a.doc.to_numpy()[left], minlength=n),
            "groups_sha256": self._digests(a, b, last_a, last_b, n),
        })
        pair = a.id.to_numpy(np.int64)[left] * self.b.size + b.id.to_numpy(np.int64)[right]
        doc = a.doc.to_numpy()[left]
        order = np.lexsort((pair, doc))
        pair, doc = pair[order], doc[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])][: len(pair)])
        times = np.diff(np.r_[first, len(pair)])
        cuts = np.searchsorted(doc[first], np.arange(1, n))
        return made, np.split(pair[first], cuts), np.split(times.astype(np.int32), cuts)

    def _digests(self, a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray, n: int) -> list[str]:
        """Hash of each text's groups, its tokens in the order group, side, place."""
        ids_a, ids_b = a.id.to_numpy(), b.id.to_numpy()
        words_a = np.where(last_a, self.written["|"][ids_a], self.written[","][ids_a])
        words_b = np.where(last_b, self.written[";"][ids_b], self.written[","][ids_b])
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # Place of each token in the text of all groups: tokens of its side before it, and of the other
        # side up to the group before (for A) or its own group (for B).
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        place_a = np.arange(len(a)) + np.r_[0, ends_b][group_a]
        place_b = np.arange(len(b)) + (ends_a[group_b] if len(b) else np.empty(0, np.int64))
        words = np.empty(len(a) + len(b), object)
        words[place_a], words[place_b] = words_a, words_b
        ends = np.cumsum(np.bincount(a.doc, minlength=n) + np.bincount(b.doc, minlength=n))
        digests, start = [], 0
        for end in ends:
            digests.append(hashlib.sha256("".join(words[start:end])[:-1].encode()).hexdigest() if end > start else "")
            start = end
        return digests


def align_documents(
    docs: DataFrame,
    path_a: str,
    pattern: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Side A encodes the text after a space by the byte-level file at ``path_a`` (split by
    ``pattern``), side B the text by the sentencepiece model at ``path_b``, which adds the
    space itself. A pair of tokens that end at one byte is a link. ``n_best`` counts links
    whose pair of ids is linked most often in all documents among those of its B id, ties
    included; ``count_sum`` sums those counts over links. Null and empty texts, and texts
    that either side's tokens do not spell byte by byte, have zeros and an empty digest and
    add nothing to the counts. Repeated rows and null ids are rows like any other; special
    tokens are plain text; other columns are ignored; an empty table gives no rows.
    """
    aligned = materialize(_align(docs, path_a, pattern, path_b, doc_id, text), "aligned")
    counts = materialize(count_pairs(aligned, load_pieces(path_b).size), "pair_counts")
    if counts.count() <= broadcast_pairs:
        return _with_counts(aligned, counts).select(*COLUMNS)
    linked = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    sums = linked.select("uid", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(counts, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = materialize(sums, "pair_sums")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.join(sums, "uid", "left").select(*[filled[COLUMNS.index(c) - 5] if c in ("n_best", "count_sum") else c for c in COLUMNS])


def _align(docs: DataFrame, path_a: str, pattern: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(path_a, pattern, path_b)
        for frame in frames:
            texts = frame.body.fillna("")
            for part in batches(texts.str.len().to_numpy(), BATCH_CHARS):
                made, pairs, times = aligner.align(texts.iloc[part].tolist())
                made.insert(0, "doc_id", frame.doc_id.iloc[part].array)
                made.insert(0, "uid", frame.uid.iloc[part].array)
                yield made.assign(pairs=pairs, times=times)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInPandas(run, schema)


def count_pairs(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no pair with its B id has more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for frame in frames:
            if not len(frame):
                continue
            pairs = np.concatenate([pairs, *frame.pairs])
            pairs, place = np.unique(pairs.astype(np.int64), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, *frame.times]), len(pairs)).astype(np.int64)
            if len(pairs) > SUMMED:
                yield pd.DataFrame({"pair": pairs, "n": counts})
                pairs, counts = pairs[:0], counts[:0]
        yield pd.DataFrame({"pair": pairs, "n": counts})

    summed = aligned.select("pairs", "times").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = materialize(summed.withColumn("b", F.col("pair") % size_b), "pairs")
    most = materialize(summed.groupBy("b").agg(F.max("n").alias("most")), "most")
    return summed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    known = counts.toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast((known.pair.to_numpy(), known.n.to_numpy(), known.best.to_numpy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = shared.value
        for frame in frames:
            if not len(frame):
                continue
            sizes = frame.pairs.str.len().to_numpy()
            place = np.searchsorted(pairs, np.concatenate([*frame.pairs]).astype(np.int64))
            times = np.concatenate([*frame.times]).astype(np.int64)
            ends = np.cumsum(sizes)
            for name, values in (("n_best", times * best[place] if len(place) else times), ("count_sum", times * n[place] if len(place) else times)):
                frame[name] = np.diff(np.r_[0, np.cumsum(values)][np.r_[0, ends]])
            yield frame[COLUMNS]

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in COLUMNS)
    return aligned.drop("uid").mapInPandas(run, schema)
