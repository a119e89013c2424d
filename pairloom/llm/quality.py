"""Quality scores learnt by pairwise ranking (Bradley-Terry), cut at a quantile.

Every pair of a good and a bad labelled text says "good above bad"; the probability of
that preference is the logistic function of the difference of their scores, and a score
is linear in features of the text. Fitting is a logistic regression without intercept on
feature differences. The cut is the quantile of the training scores that leaves as many
texts below it as are labelled bad; it is mapped to a score of CUT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize, scratch

#: Texts scoring at least this are predicted good.
CUT = 0.3
#: Scores that are sorted in one place when the cut is searched.
SORTED = 10_000
#: Partners of each labelled text in the preference pairs.
PARTNERS = 8
RIDGE = 1e-3
CLIP = 4.0

FEATURES = (
    "upper", "symbols", "exclaim", "digits", "commas", "log_words", "word_length", "distinct", "stutter", "same_lines",
)

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def text_features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; a null or empty text has all zeros but ``distinct``."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(data, minlength=256)
    size = max(1, len(data))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    words = text.split()
    n = len(words)
    unique = len(set(words))
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        upper / max(1, upper + lower),
        float(np.log1p(100 * seen[_SYMBOLS].sum() / size)),
        float(np.log1p(100 * seen[33] / size)),
        float(np.log1p(100 * seen[48:58].sum() / size)),
        float(np.log1p(100 * (seen[44] + seen[46]) / size)),
        float(np.log1p(n)),
        float(np.log1p(size / max(1, n))),
        float(np.log1p(unique) / np.log1p(n)) if n else 1.0,
        sum(map(str.__eq__, words, words[1:])) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class RankingModel:
    """A fitted ranking; ``score`` maps texts to 0..1, CUT being the quantile cut."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - np.array(self.mean)) / np.array(self.scale), -CLIP, CLIP)
        return z @ np.array(self.weights)

    def score(self, features: np.ndarray) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(self.raw(features) - self.cut + shift, -50, 50)))


def _sloped(up: np.ndarray, down: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the slope and the bend of the loss over pairs, a row of ``up`` above a row of ``down`` each."""
    pairs = up - down
    p = 1 / (1 + np.exp(-np.clip(pairs @ w, -50, 50)))
    return pairs.T @ (weight * (p - 1)), (pairs * (weight * p * (1 - p))[:, None]).T @ pairs


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n_pairs: int) -> np.ndarray:
    """Newton steps on the convex loss, given the sums over all pairs at some weights."""
    w = np.zeros(len(FEATURES))
    for _ in range(30):
        slope, bend = sums(w)
        step = np.linalg.solve(bend / n_pairs + RIDGE * np.eye(len(w)), slope / n_pairs + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _indifferent() -> RankingModel:
    d = len(FEATURES)
    return RankingModel((0.0,) * d, (1.0,) * d, (0.0,) * d, 0.0)


def _spread(scale: np.ndarray) -> np.ndarray:
    return np.where(scale < 1e-9, 1.0, scale)


def _place_of_cut(n: int, bad_share: float) -> int:
    return min(max(int(round(n * bad_share)), 1), n - 1)


def fit_ranking(features: np.ndarray, good: np.ndarray, bad_share: float | None = None) -> RankingModel:
    """Fit on labelled features. With one class only, or none, every text scores CUT and is predicted good."""
    if len(features) == 0 or good.all() or not good.any():
        return _indifferent()
    mean, scale = features.mean(0), _spread(features.std(0))
    z = np.clip((features - mean) / scale, -CLIP, CLIP)
    ups, downs = z[good], z[~good]
    n = max(len(ups), len(downs))
    rows = np.arange(n)
    # The longer class is walked through once per partner; the shorter is cycled with a growing shift.
    up = np.concatenate([ups[(rows + s * (len(ups) < n)) % len(ups)] for s in range(PARTNERS)])
    down = np.concatenate([downs[(rows + s) % len(downs)] for s in range(PARTNERS)])
    w = _newton(lambda w: _sloped(up, down, w), len(up))
    scores = np.sort(z @ w)
    below = _place_of_cut(len(scores), float((~good).mean()) if bad_share is None else bad_share)
    return RankingModel(tuple(mean), tuple(scale), tuple(w), float((scores[below - 1] + scores[below]) / 2))


def _total(table: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of what ``sums`` makes of the batches of a stored table: one vector leaves each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [sums(frame) for frame in frames if len(frame)]
        if found:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "total": [np.sum(found, axis=0)]})

    # In order of tasks, so that a sum does not depend on which task ends first.
    found = sorted(table.mapInPandas(run, "task int, total array<double>").collect(), key=lambda r: r.task)
    return np.sum([r.total for r in found], axis=0)


def _matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), float).reshape(-1, len(FEATURES))


def _numbered(learnt: DataFrame) -> tuple[DataFrame, int, int]:
    """Stored (good, at, features), numbered from 0 within either class by doc_id; how many are good, and bad."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), {True: 0, False: 0}
        for frame in frames:
            at = frame.groupby("good").cumcount() + frame.good.map(seen).astype("int64")
            for kind, n in frame.good.value_counts().items():
                seen[kind] += n
            yield pd.DataFrame({"task": task, "good": frame.good, "own": at, "features": frame.features})

    ordered = learnt.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed = materialize(ordered.mapInPandas(run, "task int, good boolean, own long, features array<double>"), "placed")
    counts = {(r.task, r.good): r["n"] for r in placed.groupBy("task", "good").agg(F.count("*").alias("n")).collect()}
    tasks = sorted({task for task, _ in counts})
    starts, n = [], {True: 0, False: 0}
    for task in tasks:
        for kind in (True, False):
            starts.append((task, kind, n[kind]))
            n[kind] += counts.get((task, kind), 0)
    first = learnt.sparkSession.createDataFrame(starts, "task int, good boolean, first long")  # two rows a task
    at = placed.join(F.broadcast(first), ["task", "good"]).select("good", (F.col("first") + F.col("own")).alias("at"), "features")
    return materialize(at, "numbered"), n[True], n[False]


def _preferences(numbered: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Stored (weight, features, partners): the pairs of ``fit_ranking``, a row of the longer class beside its partners."""
    n, few = max(n_good, n_bad), min(n_good, n_bad)
    side = F.col("good") == (n_good >= n_bad)
    at = F.col("at")
    if n_good >= n_bad:
        width, keys = PARTNERS, [(at % few, F.lit(PARTNERS))]
    else:  # both classes are walked through together, so all partners are one, but for those of the first texts
        width, own = 1, F.least(at + 1, F.lit(PARTNERS))
        keys = [(at % few, own), ((at + n) % few, PARTNERS - own)]
    named = F.explode(F.array(*[F.struct(key.cast("long").alias("key"), weight.cast("int").alias("weight")) for key, weight in keys])).alias("to")
    longer = numbered.where(side).select("at", "features", named).where("to.weight > 0").select("at", "features", "to.*")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("shift")
    windows = numbered.where(~side).select("at", "features", shifts).groupBy(F.pmod(at - F.col("shift"), F.lit(few)).alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("shift", "features")))["features"].alias("partners"))
    joined = longer.join(materialize(windows, "windows"), "key").sortWithinPartitions("key", "at")
    return materialize(joined.select("weight", "features", "partners"), "preferences")


def _order_statistic(codes: DataFrame, place: int) -> int:
    """The ``place``-th least of stored (code), from 0: counted by their leading bits, 16 at a time, until few are left."""
    shift = 48
    while shift >= 0 and codes.count() > SORTED:
        top = F.shiftright("code", shift)
        for r in sorted(codes.groupBy(top.alias("top")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.top):
            if place < r.n:
                break
            place -= r.n
        codes, shift = codes.where(top == r.top), shift - 16
    return codes.first().code if shift < 0 else sorted(r.code for r in codes.collect())[place]


def _ordered_code(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the given ones; the function is its own inverse on their bits."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def fit_stored(learnt: DataFrame) -> RankingModel:
    """``fit_ranking`` on all rows of a stored table (doc_id, good, features), in the order of doc_id, whatever its size:
    only sums over tasks and counts of scores reach the driver."""
    numbered, n_good, n_bad = _numbered(learnt)
    if not n_good or not n_bad:
        return _indifferent()
    n = n_good + n_bad
    mean = _total(numbered, lambda frame: _matrix(frame.features).sum(0)) / n
    scale = _spread(np.sqrt(_total(numbered, lambda frame: ((_matrix(frame.features) - mean) ** 2).sum(0)) / n))
    pairs, more_good, d = _preferences(numbered, n_good, n_bad), n_good >= n_bad, len(FEATURES)

    def unit(features: np.ndarray) -> np.ndarray:
        return np.clip((features - mean) / scale, -CLIP, CLIP)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(frame: pd.DataFrame) -> np.ndarray:
            many = frame.partners.map(len).to_numpy()
            own = np.repeat(unit(_matrix(frame.features)), many, axis=0)
            partner = unit(np.array([f for row in frame.partners for f in row], float).reshape(-1, d))
            weight = np.repeat(frame.weight.to_numpy() / many, many)
            slope, bend = _sloped(*((own, partner) if more_good else (partner, own)), w, weight)
            return np.r_[slope, bend.ravel()]

        total = _total(pairs, of)
        return total[:d], total[d:].reshape(d, d)

    w = _newton(sums, PARTNERS * max(n_good, n_bad))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"code": _ordered_code(unit(_matrix(frame.features)) @ w)})

    codes = materialize(numbered.mapInPandas(coded, "code long"), "codes")
    below = _place_of_cut(n, n_bad / n)
    found = np.array([_order_statistic(codes, place) for place in (below - 1, below)], np.int64)
    low, high = np.where(found < 0, found ^ np.int64(0x7FFFFFFFFFFFFFFF), found).view(np.float64)
    return RankingModel(tuple(mean), tuple(scale), tuple(w), float((low + high) / 2))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0


def train_ranking(docs: DataFrame, labels: DataFrame) -> RankingModel:
    """Fit on all labelled documents outside the held-out fold.

    Null ids or labels are left out; an id labelled both ways counts by its mean label; a
    document that occurs twice counts once.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("good"))
    )

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "features": [text_features(t) for t in frame.text]})

    with scratch(docs.sparkSession):
        # Features meet the labels, so that no text is shuffled.
        measured = docs.select("doc_id", "text").where(~held_out()).mapInPandas(measure, "doc_id long, features array<double>")
        found = measured.join(materialize(chosen, "labelled"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("features", "good")).alias("one"))
        return fit_stored(materialize(found.select("doc_id", (F.col("one.good") >= 0.5).alias("good"), "one.features"), "learnt"))


def score_texts(docs: DataFrame, model: RankingModel, columns: list[str]) -> DataFrame:
    """``columns`` of docs (which must hold ``text``) and a score for every row's whole text."""

    @F.pandas_udf("double")
    def quality_score(texts: pd.Series) -> pd.Series:
        features = np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(features))

    return docs.select(*[F.col(c) for c in columns], quality_score("text").alias("score"))


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Inputs of a score are features of the whole text only. Null texts score as empty ones;
    null ids are scored and counted as held out never; repeated rows get equal scores; an
    empty table gives no rows; other columns are ignored.
    """
    model = train_ranking(docs, labels)
    scored = score_texts(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted good."""
    model = train_ranking(docs, labels)
    names = docs.columns
    scored = score_texts(docs, model, names)
    position = len(names)  # by place: a column of docs may be called score as well
    scored = scored.toDF(*[f"c{i}" for i in range(position)], "score")
    return scored.where(F.col("score") >= CUT).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
