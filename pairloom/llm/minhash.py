"""Near copies by ProbMinHash signatures, banding, and verification.

A text is a set of five-word shingles, all of weight 1 however often they occur: links are
defined on plain sets, and the bands are sized for those. Every shingle sends arrivals of a Poisson
process with its weight as rate; each arrival hits a random register, and a register
keeps the shingle that hits it first. Two signatures agree in a register with the
probability Jaccard similarity of the two sets. Arrivals stop once they come later than
the latest register of the text. Bands of registers give candidate pairs, and a pair is
linked only if the Jaccard similarity of its shingle sets reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batches, mix, word_hashes, words_of
from pairloom.operators.cluster import connected_components
from pairloom.session import materialize, scratch

WORDS = 5
#: Similar from 4/5 on; kept as a ratio so that the comparison is exact.
SIMILAR = (4, 5)
BANDS = 32
ROWS = 4
BATCH_CHARS = 500_000
#: Leaders drawn from an open bucket at first, and how many times more in each later round.
LEADERS = 4
GROWTH = 32
#: Words of 64 bits in the parity sketch of a text's shingles.
SKETCH = 8

_STEPS = mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times) of the distinct shingles, sorted by text and hash.

    Words are lowered. A text of under five words has one shingle, its words; one without
    words has none.
    """
    hashes, counts = word_hashes([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    width = np.minimum(counts, WORDS)
    ends = np.cumsum(counts)
    n = np.where(counts > 0, counts - width + 1, 0)
    first = np.repeat(ends - counts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    text = np.repeat(np.arange(len(texts)), n)
    value = np.zeros(len(first), np.uint64)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            inside = j < width[text]
            value += np.where(inside, padded[first + j] * _STEPS[j], np.uint64(0))
        value += _STEPS[width[text] - 1] if len(text) else value
    value = mix(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.r_[at, len(text)])


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row per text; a text without shingles has a row of zeros.

    All texts advance together: round t holds the t-th arrival of every shingle that can
    still come first somewhere in its text.
    """
    earliest = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, np.uint64)
    single = np.bincount(text, minlength=n_texts) == 1
    for t, v in zip(text[single[text]], value[single[text]]):  # one shingle wins everywhere
        winner[t * registers : (t + 1) * registers] = v
    alive = np.flatnonzero(~single[text])
    clock = np.zeros(len(alive))
    latest = np.full(n_texts, np.inf)
    turn = 0
    while len(alive):
        turn += 1
        with np.errstate(over="ignore"):
            dice = mix(value[alive] + np.uint64(turn) * np.uint64(0xD1342543DE82EF95))
        uniform = ((dice >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(uniform) / weight[alive]
        owner = text[alive]
        early = clock < latest[owner]
        alive, clock, owner, dice = alive[early], clock[early], owner[early], dice[early]
        cell = owner * registers + (mix(dice) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, cell, clock)
        first = earliest[cell] == clock
        winner[cell[first]] = value[alive[first]]
        touched = np.unique(owner)
        latest[touched] = earliest.reshape(n_texts, registers)[touched].max(1)
    return winner.reshape(n_texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature; keys of different bands differ."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def similar(a: str, b: str) -> bool:
    """Whether the Jaccard similarity of the shingle sets reaches the threshold; texts without words are alike."""
    text, value, _ = shingles([a, b])
    return _similar(value[text == 0], value[text == 1])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return len(x) == len(y)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * SIMILAR[1] >= (len(x) + len(y) - common) * SIMILAR[0]


def text_keys(text):
    """Two independent 64-bit hashes that name a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def sketch(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """Stored (doc_id, uid, k1, k2, bands), one row per input row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame.body.str.len().to_numpy(), BATCH_CHARS):
                piece = frame.iloc[part]
                text_no, value, _ = shingles(piece.body.tolist())
                # Links are defined by plain sets: with equal weights two registers agree by their Jaccard similarity.
                found = signatures(text_no, value, np.ones(len(value)), len(piece), bands * rows)
                yield pd.DataFrame(
                    {
                        "doc_id": piece.doc_id.array,
                        "uid": piece.uid.array,
                        "k1": piece.k1.array,
                        "k2": piece.k2.array,
                        "bands": list(band_keys(found, bands, rows)),
                    }
                )

    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), *text_keys(body), body.alias("body")
    )
    return materialize(
        read.mapInPandas(run, f"doc_id {kind}, uid bigint, k1 bigint, k2 bigint, bands array<bigint>"), "sketches"
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, x, y) whose texts are similar enough; ``texts`` holds (node, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = np.zeros(len(frame), bool)
            for part in batches((frame.body_a.str.len() + frame.body_b.str.len()).to_numpy(), BATCH_CHARS):
                piece = frame.iloc[part]
                n = len(piece)
                owner, value, _ = shingles(piece.body_a.tolist() + piece.body_b.tolist())
                edges = np.searchsorted(owner, np.arange(2 * n + 1))
                sets = [value[i:j] for i, j in zip(edges, edges[1:])]
                good[part] = [_similar(x, y) for x, y in zip(sets[:n], sets[n:])]
            yield frame.loc[good, ["a", "b", "x", "y"]]

    a = texts.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    b = texts.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a bigint, b bigint, x bigint, y bigint")


def held_shingles(texts: DataFrame, native: bool = False) -> DataFrame:
    """Stored (node, shingle) of all texts (node, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame.body.str.len().to_numpy(), BATCH_CHARS):
                piece = frame.iloc[part]
                owner, value, _ = shingles(piece.body.tolist())
                yield pd.DataFrame({"node": piece.node.to_numpy()[owner], "shingle": value.view(np.int64)})

    if native:
        held = texts.select("node", F.explode(shingle_column(F.col("body"))).alias("shingle"))
    else:
        held = texts.select("node", "body").mapInPandas(run, "node bigint, shingle bigint")
    return materialize(held, "shingles")


def shared_shingles(held: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, size, common): how many shingles a text has, and how many of them occur in more than one part, for nodes (node, part)."""
    own = materialize(held.join(parts, "node"), "part_shingles")
    common = own.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    joined = own.join(materialize(common.select("shingle", F.lit(1).alias("one")), "common"), "shingle", "left")
    return joined.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.count("one").alias("common"))


def parity_sketches(held: DataFrame) -> DataFrame:
    """(node, s0 ...) of (node, shingle): how often a shingle falls on each bit, odd or even.

    Bits that differ between two texts are at most as many as shingles that do.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("shingle").bitwiseAND(63).cast("int"))
    word = F.shiftright("shingle", 6).bitwiseAND(SKETCH - 1)
    return held.groupBy("node").agg(*[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}") for i in range(SKETCH)])


def shingle_column(text: Column) -> Column:
    """The distinct shingle hashes of a text, sorted, by DataFrame functions; other hashes than those of ``shingles``."""
    window = lambda h, i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)])

    def of(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: window(h, i))
        few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= WORDS, whole).otherwise(few)

    # The word hashes go through an array of one, so that they are a variable and not computed anew for each window.
    hashes = F.transform(words_of(F.lower(text)), lambda word: F.xxhash64(word))
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(hashes), of), F.lit(0))))


def native_sketch(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """What ``sketch`` returns, by DataFrame functions.

    A register is the least hash from its own start on, around the circle of all hashes: it
    agrees with the plain Jaccard similarity. The rows of a band lie far apart on the circle.
    """
    n = bands * rows
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), *text_keys(body), body.alias("body"))
    read = read.withColumn("s", shingle_column(F.col("body"))).drop("body")
    cell = lambda h: F.floor((h / F.lit(2.0**63) + 1) * (n / 2)).cast("int")
    s = F.col("s")
    firsts = F.filter(s, lambda h, i: (i == 0) | (cell(h) != cell(F.get(s, i - 1))))
    read = read.withColumn("f", F.transform(firsts, lambda h: F.struct(cell(h).alias("c"), h.alias("h")))).drop("s")
    f = F.col("f")
    later = lambda j: F.get(F.filter(f, lambda x: x["c"] >= j), F.lit(0))["h"]
    registers = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(later(j), F.get(f, F.lit(0))["h"]))
    read = read.withColumn("r", registers).drop("f")
    key = lambda b: F.xxhash64(b, *[F.get("r", b + bands * j) for j in range(rows)])
    return materialize(read.withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).drop("r"), "sketches")


def native_verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """What ``verified`` returns, by DataFrame functions."""
    a = texts.select(F.col("node").alias("a"), shingle_column(F.col("body")).alias("s_a"))
    b = texts.select(F.col("node").alias("b"), shingle_column(F.col("body")).alias("s_b"))
    common, both = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b")
    return pairs.join(a, "a").join(b, "b").where(common * (SIMILAR[0] + SIMILAR[1]) >= both * SIMILAR[0]).select("a", "b", "x", "y")


def _merge(links: DataFrame) -> DataFrame:
    """Stored (id, component): what linked components become."""
    links = materialize(links.select(F.col("x").alias("src"), F.col("y").alias("dst")), "links")
    return materialize(connected_components(links), "parts")


def _renamed(rows: DataFrame, column: str, parts: DataFrame) -> DataFrame:
    own = parts.select(F.col("id").alias(column), "component")
    return rows.join(own, column, "left").withColumn(column, F.coalesce("component", column)).drop("component")


def _composed(parts: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after ``parts``, then ``more``, which names components of the former."""
    moved = _renamed(parts.withColumnRenamed("component", "part"), "part", more).withColumnRenamed("part", "component")
    return moved.unionByName(more.join(parts.select("id"), "id", "left_anti"))


def _settle(members: DataFrame, parts: DataFrame, tested: DataFrame, texts: DataFrame, check, native: bool) -> DataFrame:
    """What parts become once every pair of a bucket is connected, compared, or ruled out; round by round.

    The largest part of a bucket is its main part, and the nodes outside it are its others. Each
    round draws leaders from both: every other is compared with them, so a leader of the
    main part has met all it is not connected with, and one of the others has met all others.
    Members of a main part are never compared with each other, nor others with a main part
    they have joined. Later rounds draw more leaders, all of a bucket that has no more, so a bucket of any size comes to an end.

    Two texts meet on their sketches first: only pairs whose sketches allow the similarity become rows.
    """
    state = _renamed(members.withColumn("part", F.col("node")), "part", parts)
    state = materialize(state, "state")
    sizes = state.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mains = materialize(mains.where("parts > 1").select("bucket", "main"), "mains")
    open_ = materialize(state.join(mains, "bucket", "left_semi"), "open")
    holders = materialize(open_.select("node").distinct(), "holders")
    held = held_shingles(texts.join(holders, "node"), native)
    sketches = materialize(parity_sketches(held), "parities")
    waiting = open_.withColumn("led", F.lit(False))
    leaders = LEADERS
    while True:
        with scratch(members.sparkSession) as keep:
            waiting, undone = _undone(waiting, mains)
            if undone.isEmpty():
                return parts
            # Others that have led need to meet the main part only.
            state = materialize(waiting.join(undone, "bucket").where("both or not led"), "state")
            # The shingles that two parts have in common occur in both, so a text with few such shingles links to no other part.
            chances = shared_shingles(held, materialize(state.select("node", "part").distinct(), "part_nodes"))
            chances = chances.where(F.col("common") * SIMILAR[1] >= F.col("size") * SIMILAR[0])
            state = materialize(state.join(materialize(chances.join(sketches, "node"), "chances"), "node"), "state")
            chosen = materialize(_leaders(state, leaders), "leaders")
            pairs = keep(materialize(_meetings(state, chosen).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs"))
            tested = tested.unionByName(pairs)
            more = _merge(check(pairs, texts))
            led = chosen.select("bucket", F.col("leader").alias("node"), F.lit(True).alias("leads"))
            rest = state.join(led, ["bucket", "node"], "left").where((F.col("part") != F.col("main")) | F.col("leads").isNull())
            rest = rest.withColumn("led", F.col("led") | F.coalesce("leads", F.lit(False)))
            waiting = keep(materialize(_renamed(rest.select("bucket", "node", "part", "led"), "part", more), "waiting"))
            mains = keep(materialize(_renamed(mains, "main", more), "mains"))
            parts = keep(materialize(_composed(parts, more), "parts"))
            leaders *= GROWTH


def _undone(waiting: DataFrame, mains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: the rows that have not met all yet, with the main part of their bucket; and the buckets (bucket, both, n) with
    pairs to compare, whether between others and the main part, and their rows."""
    waiting = waiting.join(mains, "bucket").where(~F.col("led") | (F.col("part") != F.col("main")))  # one of the others that led and has joined has met all
    waiting = materialize(waiting, "waiting")
    is_main = F.col("part") == F.col("main")
    unled = waiting.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_main).alias("mains"), F.count_if(~is_main).alias("others"), F.count_if(~is_main & ~F.col("led")).alias("free"))
    undone = unled.where("others > 0 and (mains > 0 or others > 1 and free > 0)").select("bucket", (F.col("mains") > 0).alias("both"), "n")
    return waiting, materialize(undone, "undone")


def _leaders(state: DataFrame, leaders: int) -> DataFrame:
    """(bucket, of_main, leader, its, its_size, ...): up to ``leaders`` of the main part and of the others of each bucket; all, if the bucket holds no more rows."""
    salt = F.when(F.col("n") <= leaders, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(leaders)))
    drawn = state.where("not led").groupBy("bucket", salt.alias("salt"), (F.col("part") == F.col("main")).alias("of_main"))
    kept = ["size", "common", *[f"s{i}" for i in range(SKETCH)]]
    top = drawn.agg(F.max(F.struct("part", "node", *kept)).alias("top"))
    return top.select(
        "bucket", "of_main", F.col("top.node").alias("leader"), F.col("top.part").alias("its"), *[F.col(f"top.{c}").alias(f"its_{c}") for c in kept])


def _meetings(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b, x, y): the others with the leaders of their bucket that lie in another part, if common shingles and sketches allow a link."""
    others = state.where(F.col("part") != F.col("main")).drop("main", "led", "both", "n")
    whole, part = SIMILAR[0] + SIMILAR[1], SIMILAR[0]
    both = F.col("size") + F.col("its_size")
    differing = sum(F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"its_s{i}"))) for i in range(SKETCH))
    possible = (F.least("common", "its_common") * whole >= both * part) & ((both - differing) * whole >= 2 * both * part)
    own, other = F.struct(F.col("leader").alias("node"), F.col("its").alias("part")), F.struct("node", "part")
    lower, upper = F.least(own, other), F.greatest(own, other)
    met = others.join(chosen, (others["bucket"] == chosen["bucket"]) & (F.col("part") != F.col("its")) & possible)
    return met.select(lower["node"].alias("a"), upper["node"].alias("b"), lower["part"].alias("x"), upper["part"].alias("y")).distinct()


def _grouped_rows(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int, native: bool) -> DataFrame:
    """Stored (doc_id, uid, k1, k2, part): the component of every row's text."""
    check = native_verified if native else verified
    seen = (native_sketch if native else sketch)(docs, doc_id, text, bands, rows)
    nodes = materialize(seen.groupBy("k1", "k2").agg(F.min("uid").alias("node")), "nodes")
    leading = seen.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    placed = leading.select(F.col("uid").alias("node"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(placed.join(materialize(shared, "buckets"), "bucket"), "shared")
    # The leader of a bucket is the member that meets most others in its buckets: the likely centre of a group.
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    members = materialize(shared.select("bucket", "node").join(degrees, "node"), "members")
    heads = members.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("leader"))
    members = members.select("bucket", "node").join(materialize(heads, "heads"), "bucket")

    wanted = members.select("node").distinct().join(nodes, "node")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*text_keys(body), body.alias("body")).join(wanted, ["k1", "k2"]).groupBy("node")
    texts = materialize(texts.agg(F.first("body").alias("body")), "texts")

    # x and y are the components of a and b so far: at first every node is its own.
    leader = F.col("leader")
    lower, upper = F.least(leader, "node"), F.greatest(leader, "node")
    first = members.where("node <> leader").select(lower.alias("a"), upper.alias("b"), lower.alias("x"), upper.alias("y"))
    tested = materialize(first.distinct(), "pairs")
    parts = _settle(members.select("bucket", "node"), _merge(check(tested, texts)), tested, texts, check, native)
    grouped = _renamed(nodes.select("k1", "k2", F.col("node").alias("part")), "part", parts)
    return materialize(seen.select("doc_id", "uid", "k1", "k2").join(materialize(grouped, "grouped"), ["k1", "k2"]), "members")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, native: bool = False
) -> DataFrame:
    """(doc_id, uid, k1, k2, class_id, kept) for every row; ``class_id`` is the least id of the class.

    Equal texts are one node. In each bucket of a band one leader is compared with all
    members; buckets whose members are not one component yet get more leaders until every pair of a bucket is connected, compared, or ruled out: two
    texts cannot be similar if too few of their shingles occur in any other text of an open
    bucket, or if their parity sketches differ in too many bits. So a large group costs about its size
    in rows and compared texts, and no pair that could link is dropped.

    Null texts are empty; texts without words are alike and form one class; null ids
    take part and are never the least; repeated rows are in one class, of which one row is
    kept; an empty table gives no rows; other columns are ignored. ``native`` runs no Python
    on the executors.
    """
    with scratch(docs.sparkSession) as keep:
        rows_ = keep(_grouped_rows(docs, doc_id, text, bands, rows, native))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = materialize(rows_.groupBy("part").agg(first), "classes")
    return rows_.join(classes, "part").select(
        "doc_id", "uid", "k1", "k2", F.col("first.doc_id").alias("class_id"), (F.col("uid") == F.col("first.uid")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: one of each."""
    found = materialize(near_copies(docs, doc_id, text), "classes")
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = text_keys(F.coalesce(F.col(text), F.lit("")))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (k1 == F.col("__k1")) & (k2 == F.col("__k2"))
    out = docs.join(materialize(kept, "kept"), same, "left_semi")
    repeated = found.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates([doc_id, text])
