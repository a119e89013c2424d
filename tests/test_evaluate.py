import random

import pytest

from pairloom.operators import evaluate, labels, select


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    data = [(i, i + 1, round(rng.random(), 2), float(rng.random() < 0.3)) for i in range(400)]
    return data, spark.createDataFrame(data, "a_id long, b_id long, p double, label double")


def brute(data, threshold, strict=False):
    said = lambda p: p > threshold if strict else p >= threshold
    tp = sum(said(p) and y == 1 for *_, p, y in data)
    fp = sum(said(p) and y == 0 for *_, p, y in data)
    fn = sum(not said(p) and y == 1 for *_, p, y in data)
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall + 1e-9)


CURVES = [evaluate.pr_curve, lambda df: evaluate.pr_curve(df, band_scores=3), lambda df: evaluate.pr_curve(df, band_scores=1)]


@pytest.mark.parametrize("curve", CURVES)
def test_curve_equals_brute_force(scored, curve):
    data, df = scored
    rows = curve(df).collect()
    assert len(rows) == len({p for *_, p, _ in data})
    for r in rows:
        tp, fp, _, precision, recall, f1 = brute(data, r.threshold)
        assert (r.tp, r.fp) == (tp, fp)
        assert (r.precision, r.recall, r.f1) == pytest.approx((precision, recall, f1))


def test_threshold_has_the_best_f1_and_ties_go_low(spark, scored):
    data, df = scored
    choice = evaluate.pick_threshold(df)
    best = max(brute(data, t)[5] for t in {p for *_, p, _ in data})
    assert choice.best_f1 == pytest.approx(best)
    assert choice.threshold == min(t for t in {p for *_, p, _ in data} if brute(data, t)[5] == pytest.approx(best, abs=1e-15))
    assert evaluate.best_threshold(evaluate.pr_curve(df)).first()["threshold"] == choice.threshold
    half = evaluate.confusion(df, evaluate.above("p", 0.5)).first()
    assert choice.f1_at_half == pytest.approx(half["f1"])
    assert evaluate.pick_threshold(df.filter("p > 2")) == evaluate.Choice()


def test_confusion_and_global(spark, scored):
    data, df = scored
    got = evaluate.confusion(df, evaluate.above("p", 0.4)).first()
    assert (got.tp, got.fp, got.fn) == brute(data, 0.4, strict=True)[:3]
    truth = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 3)], "a_id long, b_id long")
    matches = spark.createDataFrame([(1, 1, 1.0), (9, 9, 0.0)], "a_id long, b_id long, label double")
    got = evaluate.global_confusion(matches, truth).first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 2)
    none = evaluate.confusion(df.limit(0), evaluate.above("p", 0.4)).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_labels_and_sets(spark, scored):
    _, df = scored
    truth = spark.createDataFrame([(0, 1), (0, 1), (5, 6)], "a_id long, b_id long")
    for bounded in (False, True):
        labelled = labels.label_pairs(df.drop("label"), truth, bounded)
        assert {(r.a_id, r.b_id) for r in labelled.filter("label = 1").collect()} == {(0, 1), (5, 6)}
        assert labelled.count() == 400
    asked = select.hybrid(df, 40)
    assert asked.count() <= 40
    left = labels.without(df, asked, bounded=True)
    assert left.count() + asked.count() == 400 and labels.fuse(left, asked).exceptAll(df).count() == 0


def test_selection_order(scored):
    data, df = scored
    wanted = sorted(data, key=lambda r: (abs(r[2] - 0.5), r[0], r[1]))[:15]
    assert {r.a_id for r in select.most_confused(df, 15).collect()} == {r[0] for r in wanted}
    wanted = sorted(data, key=lambda r: (-r[2], r[0], r[1]))[:15]
    assert {r.a_id for r in select.most_confident(df, 15).collect()} == {r[0] for r in wanted}


def test_class_weights_with_one_class(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "label double")
    assert {r.label: r.weight for r in labels.class_weights(df).collect()} == {0.0: 1.0, 1.0: 0.5}


def test_missing_records_drop_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "a_id long, b_id long")
    a, b = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "id long")
    assert [tuple(r) for r in labels.resolvable(pairs, a, b).select("a_id", "b_id").collect()] == [(1, 2)]
    assert labels.label_stats(spark.createDataFrame([(1.0,), (0.0,), (0.0,)], "label double")).first() == (3, 1, 2)


def test_bands_stay_even_for_crowded_scores(spark):
    crowded = spark.range(20_000).selectExpr("id AS a_id", "id AS b_id", "id / 20000.0 * 1e-5 AS p", "double(id % 3 = 0) AS label")
    curve = evaluate.pr_curve(crowded, band_scores=20)
    assert curve.count() == 20_000
    last = curve.orderBy("threshold").first()
    assert (last.tp, last.fp) == (6667, 13333)
