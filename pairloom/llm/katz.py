"""Language-model scores by Katz backoff over word bigrams.

p(w | h) = d(c) c / (c(h) + 1) for a bigram counted c times, and a(h) p(w) else;
p(w) = d(c) c / (N + 1) for a known word, and what is left for the unknown one.
d(c) are Good-Turing discounts for c <= K and 1 above. The denominators hold one event
more than was seen, so something is left in every context, and a(h) is exactly what
makes the probabilities of all known words and the unknown one sum to 1.

How the counts meet the texts. Words are named by number if they are frequent (a list of
bounded size that every task has) and by hash else. The bigrams of a batch of documents
go to hash partitions, one packed row per batch and partition: by context if the word is
frequent (the few hottest contexts by both words), by word else. A partition then holds
all of a bigram, so it counts it, and answers each batch with the counts of its entries.
The batch's answers meet again, and its documents are summed. Discounts are needed only
for sums per small count, so they come last; so do the backoff weights, which are stored
by context and joined with the events that were not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, mix, word_hashes
from pairloom.session import materialize

#: Counts up to K are discounted.
K = 5
FOLDS = 10
#: A frequent word makes up more than 1 / FREQUENT of the tokens, so there are fewer than FREQUENT.
FREQUENT = 1 << 17
#: Contexts among the hottest are split over partitions by their word.
HOTTEST = 1024
#: Entries a partition holds, about.
GROUP_TOKENS = 1_000_000
BATCH_CHARS = 4_000_000
#: Distinct words a task counts before it passes the counts on.
COUNTED = 2_000_000
END, BEGIN = np.int64(0), np.int64(1)
#: Numbers of rare words start here; those of frequent words lie below.
RARE = np.int64(1 << 62)
#: Buckets in which the backoff weights are stored.
BUCKETS = 16

DOC, CONTEXT, UNSEEN, COUNTS = range(4)
OUT = "kind int, key bigint, other bigint, n bigint, known bigint, held boolean, x double, y double, r array<bigint>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, by byte planes, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens (hashes of words, then END) of the texts, and how many each text has."""
    words, counts = word_hashes(texts)
    words = words.view(np.int64).copy()
    words[(words == END) | (words == BEGIN)] += 2
    out = np.empty(len(words) + len(texts), np.int64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words, END
    return out, counts + 1


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(1) .. d(K) from the numbers of events counted 1 .. K + 1 times.

    Where Good-Turing gives nothing between 0 and 1 (as it may on few data), half a count is taken off.
    """
    n = np.asarray(counts, float)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return np.where((d > 0) & (d < 1), d, 1 - 0.5 / r)


class Unigrams:
    """What every task knows: totals, the frequent words, and word probabilities by count."""

    def __init__(self, total: int, distinct: int, texts: int, by_count: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.total, self.distinct, self.texts = total, distinct, texts
        self.words, self.counts = words[order], counts[order]
        self.d = discounts(by_count)
        mass = total - float((by_count[:K] * np.arange(1, K + 1) * (1 - self.d)).sum())
        self.unknown = 1 - mass / (total + 1)
        hottest = np.argsort(-self.counts, kind="stable")[:HOTTEST]
        self.hot = np.zeros(len(words) + 1, bool)
        self.hot[hottest] = True
        self.begin = np.int64(len(words))  # the start of a text, as a context only
        self.hot[self.begin] = True
        rare = total - int(counts.sum())
        self.frequent_groups = max(1, -(-int(counts.sum()) // GROUP_TOKENS))
        self.rare_groups = max(1, -(-rare // GROUP_TOKENS))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[place] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(known, place, (hashes & (RARE - 1)) | RARE)

    def probability(self, count: np.ndarray) -> np.ndarray:
        small = np.clip(count, 1, K) - 1
        return np.where(count == 0, self.unknown, np.where(count <= K, self.d[small], 1.0) * count / (self.total + 1))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def group(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The partition of each bigram: frequent words first, then rare ones."""
        with np.errstate(over="ignore"):
            both = mix(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))
        hot = (context < RARE) & self.hot[np.minimum(context, self.begin)]
        key = np.where(hot, both, mix(context.view(np.uint64)))
        by_context = (key % np.uint64(self.frequent_groups)).astype(np.int64)
        by_word = self.frequent_groups + (mix(word.view(np.uint64)) % np.uint64(self.rare_groups)).astype(np.int64)
        return np.where(word < RARE, by_context, by_word)


def count_words(docs: DataFrame) -> DataFrame:
    """Stored (word, n) over the training texts of ``docs`` (body, held)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for frame in frames:
            texts = frame.body[~frame.held]
            for part in batches(texts.str.len().to_numpy(), BATCH_CHARS):
                more, times = np.unique(tokens_of(texts.iloc[part].tolist())[0], return_counts=True)
                words, where = np.unique(np.concatenate([words, more]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, times]), len(words)).astype(np.int64)
                if len(words) > COUNTED:
                    yield pd.DataFrame({"word": words, "n": counts})
                    words, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(words):
            yield pd.DataFrame({"word": words, "n": counts})

    counted = docs.select("body", "held").mapInPandas(run, "word bigint, n bigint")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


def learn_words(docs: DataFrame) -> Unigrams:
    words = count_words(docs)
    row = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.max(F.when(F.col("word") == int(END), F.col("n"))), F.lit(0)).alias("texts"),
        *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, K + 2)],
    ).first()
    # At most FREQUENT words can each make up more than 1 / FREQUENT of all tokens.
    frequent = words.where((F.col("n") > row.total / FREQUENT) | (F.col("word") == int(END))).collect()
    return Unigrams(
        row.total, row.distinct, row.texts, np.array([row[f"n{r}"] for r in range(1, K + 2)], float),
        np.array([r.word for r in frequent], np.int64), np.array([r.n for r in frequent], np.int64),
    )


def deal(docs: DataFrame, words: Unigrams) -> DataFrame:
    """(part, base, n, data): the distinct bigrams of a batch for one partition, or (part < 0) the batch's documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame.body.str.len().to_numpy(), BATCH_CHARS):
                piece = frame.iloc[part]
                yield _deal_batch(piece, words)

    return docs.select("doc_id", "uid", "body", "held").mapInPandas(run, "part bigint, base bigint, n int, data binary")


def _deal_batch(docs: pd.DataFrame, words: Unigrams) -> pd.DataFrame:
    texts, uids, held = docs.body.tolist(), docs.uid.to_numpy(), docs.held.to_numpy(bool)
    nameless = docs.doc_id.isna().to_numpy()
    names = docs.doc_id.astype("Int64").fillna(0).to_numpy(np.int64)
    base = int(uids[0])
    hashes, sizes = tokens_of(texts)
    word = words.number(hashes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = np.cumsum(sizes) - 1
    context = np.r_[words.begin, word[:-1]]
    context[np.r_[0, last[:-1] + 1]] = words.begin
    # What frequent words add to a document is known here already.
    count = np.zeros(len(word), np.int64)
    frequent = word < RARE
    count[frequent] = words.counts[word[frequent]]
    n = len(texts)
    own = owner[frequent]
    sums = [
        np.bincount(own, words.base(count[frequent]), n),
        np.bincount(own, np.where(hashes[frequent] == END, 0.0, np.log10(count[frequent] + 1.0)), n),
        np.bincount(own, minlength=n).astype(np.int64),
    ]
    rows = [(-1 - base, base, n, pack(uids - base, names, nameless, sizes, held, *sums))]
    group = words.group(context, word)
    order = np.lexsort((owner, context, word, group))
    group, word, context, owner = group[order], word[order], context[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(context) != 0) | (np.diff(word) != 0) | (np.diff(group) != 0)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(order)])
    group, word, context, owner = group[at], word[at], context[at], owner[at]
    edges = np.flatnonzero(np.r_[True, np.diff(group) != 0, True]) if len(group) else np.zeros(1, np.int64)
    for i, j in zip(edges, edges[1:]):
        data = pack(word[i:j], context[i:j], (uids[owner[i:j]] - base) * 2 + held[owner[i:j]], times[i:j].astype(np.uint32))
        rows.append((int(group[i]), base, int(j - i), data))
    return pd.DataFrame(rows, columns=["part", "base", "n", "data"])


ENTRY = ("i8", "i8", "i8", "u4")
ANSWER = ("i8", "u4", "i8", "i8", "i8")


def answer(group: pd.DataFrame, words: Unigrams) -> pd.DataFrame:
    """Counts the bigrams of one partition. Rows (base, n, m, data): an answer per batch, and the partition's contexts."""
    part = int(group.part.iloc[0])
    if part < 0:
        return pd.DataFrame({"base": group.base, "n": group.n, "m": -1, "data": group.data})
    bases = group.base.to_numpy()
    read = [unpack(data, n, *ENTRY) for data, n in zip(group.data, group.n)]
    word, context, doc, times = (np.concatenate(x) for x in zip(*read))
    batch = np.repeat(np.arange(len(group)), group.n)
    order = np.lexsort((context, word))
    word_s, context_s = word[order], context[order]
    learnt = np.where(doc[order] & 1, 0, times[order]).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(word_s) != 0) | (np.diff(context_s) != 0)
    at = np.flatnonzero(new)
    counts = np.add.reduceat(learnt, at)
    bigram = np.cumsum(new) - 1
    first = np.flatnonzero(np.r_[True, np.diff(word_s) != 0])
    rare = part >= words.frequent_groups
    if rare:  # every token of a rare word is in this partition once
        of_word = np.add.reduceat(learnt, first)[np.cumsum(np.r_[True, np.diff(word_s) != 0]) - 1]
    else:
        of_word = words.counts[word_s]

    seen = counts > 0
    c, h, p = counts[seen], context_s[at[seen]], words.probability(of_word[at[seen]])
    names, where = np.unique(h, return_inverse=True)
    mass = np.bincount(where, np.where(c > K, c, 0), len(names))
    left = np.bincount(where, p, len(names))
    small = [np.bincount(where, c == r, len(names)).astype(np.int64) for r in range(1, K + 1)]
    rows = [
        (-2 - 2 * part, len(names), -1, pack(names, mass, left, *small)),
        (-3 - 2 * part, 1, -1, pack(*[np.array([int((c == r).sum())]) for r in range(1, K + 2)])),
    ]
    back = np.empty(len(order), np.int64)
    back[order] = counts[bigram]
    known = np.empty(len(order), np.int64)
    known[order] = of_word
    for b in range(len(group)):
        own = np.flatnonzero(batch == b) if len(group) == 1 else slice(*np.searchsorted(batch, [b, b + 1]))
        arrays = [doc[own] >> 1, times[own], back[own], known[own], context[own]]
        by_doc = np.argsort(arrays[0], kind="stable")
        arrays = [a[by_doc] for a in arrays]
        unseen = arrays[2] == 0
        arrays[4] = np.where(unseen, arrays[4], 0)  # the context matters for unseen events only
        if not rare:
            arrays[3] = np.where(unseen, arrays[3], 0)
        rows.append((int(bases[b]), len(arrays[0]), int(rare), pack(*arrays)))
    return pd.DataFrame(rows, columns=["base", "n", "m", "data"])


def gather(group: pd.DataFrame, words: Unigrams) -> pd.DataFrame:
    """Sums a batch's documents over all answers; hands on contexts and counts of counts."""
    base = int(group.base.iloc[0])
    none = {"other": None, "n": None, "known": None, "held": None, "x": None, "y": None}
    if base < 0:
        made = []
        for n, data in zip(group.n, group.data):
            if base % 2:
                made.append(none | {"kind": COUNTS, "key": 0, "r": np.concatenate(unpack(data, n, *["i8"] * (K + 1)))})
                made[-1] = pd.DataFrame([made[-1]])
            else:
                names, mass, left, *small = unpack(data, n, "i8", "f8", "f8", *["i8"] * K)
                made.append(pd.DataFrame(none | {"kind": CONTEXT, "key": names, "x": mass, "y": left, "r": list(np.stack(small, 1))}))
        return pd.concat(map(_typed, made))
    head = group[group.m < 0].iloc[0]
    kinds = ("i8", "i8", "u1", "i8", "u1", "f8", "f8", "i8")
    offset, names, nameless, sizes, held, base_sum, context_sum, known = unpack(head.data, head.n, *kinds)
    span = int(offset[-1]) + 1
    base_sum, context_sum, known = (np.bincount(offset, a, span) for a in (base_sum, context_sum, known))
    fixed, small = np.zeros(span), np.zeros((span, K))
    missed = []
    for row in group[group.m >= 0].itertuples(index=False):
        doc, times, count, of_word, context = unpack(row.data, row.n, *ANSWER)
        if row.m:
            base_sum += np.bincount(doc, times * words.base(of_word), span)
            context_sum += np.bincount(doc, times * np.log10(of_word + 1.0), span)
            known += np.bincount(doc, times * (of_word > 0), span)
        many = count > K
        fixed += np.bincount(doc[many], times[many] * np.log10(count[many]), span)
        for r in range(1, K + 1):
            own = count == r
            small[:, r - 1] += np.bincount(doc[own], times[own], span)
        unseen = count == 0
        fixed += np.bincount(doc[unseen], times[unseen] * np.log10(words.probability(of_word[unseen])), span)
        missed.append((doc[unseen], times[unseen], context[unseen]))
    fixed -= context_sum + np.log10(words.texts + 1.0)
    docs = pd.DataFrame(
        none
        | {
            "kind": DOC, "key": base + offset, "other": pd.Series(names, dtype="Int64").mask(nameless.astype(bool)), "n": sizes, "known": np.rint(known[offset]).astype(np.int64), "held": held.astype(bool),
            "x": base_sum[offset], "y": fixed[offset], "r": list(small[offset].astype(np.int64)),
        }
    )
    doc, times, context = (np.concatenate(a) for a in zip(*missed)) if missed else (np.empty(0, np.int64),) * 3
    events = pd.DataFrame(none | {"kind": UNSEEN, "key": base + doc, "other": context, "n": times.astype(np.int64), "r": None})
    return pd.concat([_typed(docs), _typed(events)])


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    columns = [f.split()[0] for f in OUT.split(", ")]
    return frame[columns].astype(
        {"kind": "int32", "key": "int64", "other": "Int64", "n": "Int64", "known": "Int64", "held": "boolean", "x": "Float64", "y": "Float64", "r": "object"}
    )


def backoff_weights(found: DataFrame, d: np.ndarray) -> DataFrame:
    """Stored by bucket: (context, gain), gain being log10 of a(h) (c(h) + 1)."""
    sums = found.where(F.col("kind") == CONTEXT).groupBy("key").agg(
        F.sum("x").alias("mass"), F.sum("y").alias("left"), *[F.sum(F.col("r")[i]).alias(f"m{i + 1}") for i in range(K)]
    )
    total = sum((F.col(f"m{r}") * r for r in range(1, K + 1)), F.col("mass"))
    used = sum((F.col(f"m{r}") * float(r * d[r - 1]) for r in range(1, K + 1)), F.col("mass"))
    # a(h) (c(h) + 1) = (c(h) + 1 - used) / (1 - left)
    gain = F.log10((total + 1 - used) / (1 - F.col("left")))
    weights = sums.select(F.col("key").alias("context"), gain.alias("gain"), F.pmod("key", F.lit(BUCKETS)).alias("bucket"))
    return materialize(weights, "backoff", partition_by="bucket")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A row is held out if crc32 of its id as text is 0 modulo ``folds``; all others train the
    model. Scores are log10 probabilities of the whole text with its end. Null texts are
    empty: they hold the end alone. Rows of null id train and are scored. Repeated rows
    count as often as they occur. With no training row every word is unknown. An empty
    table gives no rows; other columns are ignored.
    """
    number = F.col(doc_id).cast("string").cast("binary")
    read = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.pmod(F.crc32(number), F.lit(folds)) == 0, F.lit(False)).alias("held"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    words = learn_words(read)
    answers = deal(read, words).groupBy("part").applyInPandas(
        lambda g: answer(g, words), "base bigint, n int, m int, data binary"
    )
    found = materialize(answers.groupBy("base").applyInPandas(lambda g: gather(g, words), OUT), "scored")

    sums = found.where(F.col("kind") == COUNTS).agg(*[F.coalesce(F.sum(F.col("r")[i]), F.lit(0)) for i in range(K + 1)]).first()
    d = discounts(np.array(list(sums), float))
    weights = backoff_weights(found, d).select("context", "gain")
    missed = found.where(F.col("kind") == UNSEEN).select(F.col("key").alias("uid"), F.col("other").alias("context"), "n")
    gains = missed.join(weights, "context").groupBy("uid").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    small = sum((F.col("r")[r - 1] * float(np.log10(d[r - 1] * r)) for r in range(1, K + 1)), F.lit(0.0))
    scored = found.where(F.col("kind") == DOC).select(
        F.col("key").alias("uid"), F.col("other").alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"), F.col("x").alias("base_score"), (F.col("y") + small).alias("part_score"),
    )
    return scored.join(gains, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        (F.col("part_score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
