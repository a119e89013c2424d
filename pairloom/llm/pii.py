"""Personal data: four base patterns, and more identifiers found through the contexts they share with those.

The base patterns give seed instances. Each identifier-like string (base match or not)
stands in lexical contexts, its patterns. Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the share of its instances that are
believed in, an instance as good as its best patterns. Patterns above a high bar then
mark identifiers no base pattern matched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize

#: In the order in which kinds are listed when they start at one place.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like: a run of id characters; it counts with an at sign or enough digits.
LIKE = re.compile(r"[A-Za-z0-9+@][A-Za-z0-9@._%+/-]*[A-Za-z0-9]")
LIKE_DIGITS = 6

ROUNDS = 3
#: Different seed instances a pattern needs, and the weight of doubt against it.
SUPPORT = 5
DOUBT = 1.0
#: Patterns below this confidence discover nothing.
CONFIDENT = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start and kind; code points, end exclusive.

    Each kind is searched from left to right without overlap within itself; a match that fails its
    check is dropped and not searched again.
    """
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(text: str) -> list[str]:
    return [w for w in (w.strip("\"'.,;:!?()[]*#$%&|<>").lower() for w in text.split()) if w]


def contexts(text: str, start: int, end: int) -> list[int]:
    """Keys of the lexical patterns around a span: two words before, two after, one on each side."""
    left, right = _words(text[max(0, start - 80) : start])[-2:], _words(text[end : end + 80])[:2]
    found = []
    if len(left) == 2:
        found.append(_key("before", *left))
    if len(right) == 2:
        found.append(_key("after", *right))
    if left and right:
        found.append(_key("around", left[-1], right[0]))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, instance, patterns) of base matches and of other identifier-like strings."""
    found = [(s, e, k, _key(text[s:e].lower()), contexts(text, s, e)) for s, k, e in base]
    taken: list[list[int]] = []  # base spans, joined where they overlap
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    place = 0
    for m in LIKE.finditer(text):
        body = m[0]
        if "@" not in body and sum(c.isdigit() for c in body) < LIKE_DIGITS:
            continue
        while place < len(taken) and taken[place][1] <= m.start():
            place += 1
        if place < len(taken) and taken[place][0] < m.end():
            continue
        found.append((m.start(), m.end(), -1, _key(body.lower()), contexts(text, m.start(), m.end())))
    return found


FOUND = "array<struct<start:int,end:int,kind:int,instance:bigint,patterns:array<bigint>>>"


def extract(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One stored row per document: its key, its base spans and its identifier-like strings with contexts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [base_spans(t) if t else [] for t in frame.body]
            yield pd.DataFrame(
                {
                    "doc_id": frame.doc_id,
                    "text_key": frame.text_key,
                    "base": [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base],
                    "found": [
                        [dict(zip(("start", "end", "kind", "instance", "patterns"), c)) for c in candidates(t, b)]
                        if t
                        else []
                        for t, b in zip(frame.body, base)
                    ],
                }
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("body"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, base array<struct<start:int,kind:int,end:int>>, found {FOUND}"
    return materialize(rows.mapInPandas(run, schema), "pii_found")


def confident_patterns(
    found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT
) -> DataFrame:
    """(pattern, kind, score) of the patterns that may discover identifiers.

    One round: a pattern's score is the belief in its distinct instances, divided by their
    number and DOUBT; an instance that is no seed is believed in as much as its patterns
    miss together (1 - product of 1 - score). Only patterns with ``support`` different seed instances
    take part. Sums run on distinct (pattern, instance) edges with partial aggregation.
    """
    edges = (
        found.select(F.explode("found").alias("one"))
        .select(F.explode("one.patterns").alias("pattern"), F.col("one.instance").alias("instance"), F.col("one.kind").alias("kind"))
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("kind"))
    )
    edges = materialize(edges, "pii_edges")
    seeded = edges.groupBy("pattern").agg(F.count_if(F.col("kind") >= 0).alias("seeds")).where(F.col("seeds") >= support)
    edges = materialize(edges.join(materialize(seeded, "pii_seeded").select("pattern"), "pattern", "left_semi"), "pii_graph")
    seed = F.when(F.col("kind") >= 0, 1.0)
    beliefs = materialize(edges.groupBy("instance").agg(F.coalesce(F.max(seed), F.lit(0.0)).alias("belief")), "pii_beliefs")
    for _ in range(rounds):
        scores = (
            edges.join(beliefs, "instance")
            .groupBy("pattern")
            .agg((F.sum("belief") / (F.count(F.lit(1)) + DOUBT)).alias("score"), F.max("kind").alias("kind"))
        )
        scores = materialize(scores, "pii_scores")
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12))))
        beliefs = (
            edges.join(scores.select("pattern", "score"), "pattern")
            .groupBy("instance")
            .agg(F.coalesce(F.max(seed), 1 - F.exp(doubt)).alias("belief"))
        )
        beliefs = materialize(beliefs, "pii_beliefs")
    return scores.where((F.col("score") >= confident) & (F.col("kind") >= 0))


def added_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_key, added: array of (start, kind, end)) for the texts in which confident patterns mark more identifiers."""
    unseen = (
        found.select("text_key", F.explode("found").alias("one"))
        .where(F.col("one.kind") < 0)
        .select("text_key", "one.start", "one.end", F.explode("one.patterns").alias("pattern"))
    )
    marked = unseen.join(patterns.select("pattern", "kind"), "pattern").groupBy("text_key", "start", "end")
    marked = marked.agg(F.min("kind").alias("kind"))
    return marked.groupBy("text_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, base, added) for every row: spans as arrays of (start, kind, end), sorted.

    ``added`` never overlaps a base span. Null and empty texts have no spans; null ids and
    repeated rows are rows like any other; an empty table gives no rows; other columns are
    ignored. Texts of any length are searched whole.
    """
    found = extract(docs, doc_id, text)
    added = materialize(added_spans(found, confident_patterns(found)), "pii_added")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = found.select("doc_id", "text_key", "base").join(added, "text_key", "left")
    return rows.select("doc_id", "text_key", "base", F.sort_array(F.coalesce("added", none)).alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` (if there) set to the new length.

    Spans that overlap are replaced together, by the name of the one that starts first.
    """
    found = extract(docs, doc_id, text)
    added = materialize(added_spans(found, confident_patterns(found)), "pii_added")
    added = added.select(F.col("text_key").alias("__key"), F.col("added").alias("__added"))

    @F.pandas_udf("string")
    def hide(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for body, extra in zip(texts, more):
            if not body:
                out.append(body)
                continue
            spans = base_spans(body) + [(s["start"], s["kind"], s["end"]) for s in (extra if extra is not None else [])]
            parts, place = [], 0
            for start, kind, end in sorted(spans):
                if start >= place:
                    parts += [body[place:start], f"[{KINDS[kind]}]"]
                place = max(place, end)
            out.append("".join([*parts, body[place:]]) if spans else body)
        return pd.Series(out, dtype=object)

    joined = docs.join(added, F.xxhash64(text) == F.col("__key"), "left").withColumn(text, hide(F.col(text), F.col("__added")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
