import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.catalog import REGISTRY
from pairloom.functions.vectors import cosine
from pairloom.operators import knn


def frame(spark, matrix, first=0, step=1, text=False):
    data = [(str(first + i * step) if text else first + i * step, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, f"id {'string' if text else 'long'}, v array<double>").repartition(3)


def brute(queries, index, k, exclude=False):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    sims = np.round(unit(queries) @ unit(index).T, 6)
    out = set()
    for q, row in enumerate(sims):
        order = [i for i in np.lexsort((np.arange(len(row)), -row)) if not (exclude and i == q)]
        out |= {(q, int(i), rank + 1) for rank, i in enumerate(order[:k])}
    return out


def found(df):
    return {(r.query_id, r.index_id, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    index, queries = rng.normal(size=(300, 8)), rng.normal(size=(80, 8))
    index[:100] = index[0]  # a third of the index is one vector
    index[120] = 0  # a zero row
    queries[:30] = queries[0]
    queries[5] = 0
    return queries, index


PATHS = [{}, {"block_rows": 16}, {"block_rows": 64}]


@pytest.mark.parametrize("options", PATHS)
def test_exact_paths_equal_brute_force(spark, data, options):
    queries, index = data
    got = knn.knn_join_exact(frame(spark, queries), frame(spark, index), 7, **options)
    assert found(got) == brute(queries, index, 7)


@pytest.mark.parametrize("options", PATHS)
def test_self_join_leaves_out_the_row_itself(spark, data, options):
    _, index = data
    assert found(knn.knn_self_join(frame(spark, index), 4, **options)) == brute(index, index, 4, exclude=True)


@pytest.mark.parametrize("options", PATHS)
def test_fewer_index_rows_than_k(spark, data, options):
    queries, index = data
    got = knn.knn_join_exact(frame(spark, queries[:6]), frame(spark, index[:3]), 5, **options)
    assert found(got) == brute(queries[:6], index[:3], 5)


def test_unusable_vectors_are_left_out(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (None, [1.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0])], "id long, v array<double>")
    assert found(knn.knn_join_exact(queries, index, 3)) == {(7, 1, 1)}


def test_string_ids(spark, data):
    queries, index = data
    got = knn.knn_join_exact(frame(spark, queries[:5], text=True), frame(spark, index[100:], text=True), 3)
    assert got.count() == 15 and dict(got.dtypes)["index_id"] == "string"


def all_rows(n):
    """Rows in a few directions, with copies."""
    rng = np.random.default_rng(3)
    return rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * rng.choice([0, 0.3], (n, 1))


@pytest.mark.parametrize("options", [{}, {"coarse_rows": 40}, {"coarse_rows": 40, "slice_rows": 25}])
def test_a_tree_with_all_leaves_visited_is_exact(spark, data, options):
    queries, index = data
    built = knn.build_cells(frame(spark, index), **options)
    assert built.n_rows == 300 and built.rows.count() == 300
    assert built.leaves.agg(F.sum("n")).first()[0] == 300
    got = knn.knn_join_cells(frame(spark, queries), built, 5, probes=(99, 999), block_rows=32)
    assert found(got) == brute(queries, index, 5)


def test_k_is_always_reached(spark, data):
    queries, index = data
    for join, options in ((knn.knn_join_cells, {"probes": (1, 1)}), (knn.knn_join_buckets, {"probes": 1, "bands": 1})):
        got = join(frame(spark, queries), frame(spark, index), 40, **options).groupBy("query_id").count().collect()
        assert len(got) == 80 and {r["count"] for r in got} == {40}


@pytest.mark.parametrize("search", ["cells", "buckets"])
def test_self_joins_of_both_approximate_kinds(spark, data, search):
    _, index = data
    got = found(knn.knn_self_join(frame(spark, index), 4, search=search, recall=1.0))
    assert all(q != i for q, i, _ in got) and len(got) == 1200
    assert len(got & brute(index, index, 4, exclude=True)) >= 0.85 * 1200


def test_index_is_reusable(spark, data):
    queries, index = data
    built = knn.build_cells(frame(spark, index))
    assert knn.knn_join(frame(spark, queries), built, 3, search="cells").count() == 240
    with pytest.raises(ValueError):
        knn.knn_join(frame(spark, queries), frame(spark, index), 3, search="magic")


def test_visits_reach_the_wanted_recall_and_no_more_than_needed(spark):
    index, queries = all_rows(3000), all_rows(300)
    built = knn.build_cells(frame(spark, index), coarse_rows=500)
    wide = knn.calibrate_cells(frame(spark, queries), built, 5, recall=0.99)
    narrow = knn.calibrate_cells(frame(spark, queries), built, 5, recall=0.6)
    assert narrow[0] <= wide[0] and narrow[1] < wide[1]
    true = {(q, i) for q, i, _ in brute(queries, index, 5)}
    for join in (lambda: knn.knn_join_cells(frame(spark, queries), built, 5), lambda: knn.knn_join_buckets(frame(spark, queries), frame(spark, index), 5)):
        got = join().collect()
        sims = {}
        for r in got:
            sims.setdefault(r.query_id, []).append(r.sim)
        assert len(got) == 1500 and len({(r.query_id, r.index_id) for r in got} & true) >= 0.9 * 1500


def test_one_path_at_every_size(spark):
    """Ten rows and two hundred thousand go the same way, and the tree takes in all of them."""
    plans = []
    for n in (10, 200_000):
        index = spark.range(n).select("id", F.array(*[F.sin(F.col("id") * (i + 1) * 0.37) for i in range(4)]).alias("v"))
        built = knn.build_cells(index)
        assert built.rows.count() == n and built.leaves.agg(F.sum("n")).first()[0] == n
        asked = spark.range(5).select("id", F.array(*[F.sin(F.col("id") * (i + 1) * 0.37) for i in range(4)]).alias("v"))
        got = knn.knn_join_cells(asked, built, 1, probes=(2, 4))
        assert {(r.query_id, r.index_id) for r in got.collect()} == {(i, i) for i in range(5)}
        plans.append([w for w in got._jdf.queryExecution().sparkPlan().toString().split() if "FlatMap" in w or "Window" in w])
    assert plans[0] == plans[1]


def test_buckets_around_a_row_come_in_order_of_distance():
    rng = np.random.default_rng(0)
    projections = knn.Projections(rng.normal(size=(6, 6)), rng.uniform(size=6), np.ones(6), 2)
    steps = projections.steps()
    assert len(steps) == 27 and len({tuple(s) for s in steps}) == 27 and not steps[0].any()
    places = projections.places(rng.normal(size=(4, 6)))
    away = projections.away(places)
    for row, band, at in np.ndindex(away.shape):
        low = np.floor(places[row, band]) + steps[at]
        gap = np.maximum(np.maximum(low - places[row, band], places[row, band] - low - 1), 0)
        assert np.isclose(away[row, band, at], (gap**2).sum())
    many = knn.Projections(rng.normal(size=(6, 17)), np.zeros(17), np.ones(17), 1).steps()
    assert len(many) <= knn.PROBES and (np.abs(many).sum(1) <= 2).all()


def test_recall_on_real_vectors(spark, small):
    from pairloom.catalog.neighbours import knn_recall

    for folder in (small, "/root/testdata/sf0.1"):
        got = {r.method: r for r in knn_recall(spark, folder).collect()}
        assert got["ivf"].recall >= 0.9 and got["lsh"].recall >= 0.9
        assert got["ivf"].compared < 1


def test_similarities_are_cosines(spark, data):
    queries, index = data
    got = knn.knn_join_exact(frame(spark, queries), frame(spark, index), 5)
    q = frame(spark, queries).select(F.col("id").alias("query_id"), F.col("v").alias("x"))
    i = frame(spark, index).select(F.col("id").alias("index_id"), F.col("v").alias("y"))
    worst = got.join(q, "query_id").join(i, "index_id").agg(
        F.max(F.abs(cosine(F.col("x"), F.col("y")) - F.col("sim"))).alias("e"), F.max(F.abs("sim")).alias("m")).first()
    assert worst["e"] < 1e-6 and worst["m"] <= 1.0


def test_large_path_has_no_cross_join(spark, data):
    queries, index = data
    got = knn.knn_join_exact(frame(spark, queries), frame(spark, index), 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in plan


def test_many_small_blocks_meet_within_a_task(spark, monkeypatch):
    """Each pair of blocks was a group of its own: rows travelled, and top k came back, once per block of 16."""
    came = []
    ranked = knn._ranked
    monkeypatch.setattr(knn, "_ranked", lambda found, *rest: came.append(found.count()) or ranked(found, *rest))
    rng = np.random.default_rng(3)
    queries, index = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (n, 4)).astype(float))], "id long, v array<double>") for n in (20, 400))
    small = sorted(map(tuple, knn.knn_join_exact(queries, index, 3, block_rows=16).collect()))
    assert came[0] <= 20 * 3 * spark.sparkContext.defaultParallelism
    assert small == sorted(map(tuple, knn.knn_join_exact(queries, index, 3).collect())) and len(small) == 60
    own = sorted(map(tuple, knn.knn_join_exact(index, index, 3, exclude_self=True, block_rows=16).collect()))
    assert own == sorted(map(tuple, knn.knn_join_exact(index, index, 3, exclude_self=True).collect())) and all(r[0] != r[1] for r in own)


def test_rows_probed_at_once_are_bounded():
    """1,024 rows were probed at once, however many buckets each visits."""
    for bands, probes in ((1, 1), (2, 900), (16, 1000)):
        wide = knn.Projections(np.ones((4, 12 * bands)), np.zeros(12 * bands), np.ones(12 * bands), bands, probes)
        assert 1 <= wide.at_once(probes) and wide.at_once(probes) * bands * probes * 13 <= knn.TILE


def test_a_query_travels_once_to_the_leaves_of_a_slice(spark, monkeypatch):
    """Many leaves, few slices: what meets is a row per query and slice, and the neighbours are the exact ones."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 8)).tolist())], "id long, v array<double>")
    built = knn.build_cells(rows, coarse_rows=400)
    stored, real = {}, knn.materialize

    def store(df, name):
        stored[name] = real(df, name)
        return stored[name]

    monkeypatch.setattr(knn, "materialize", store)
    got = knn.knn_join_cells(rows, built, 4, probes=(2**30, 2**30), exclude_self=True)
    exact = knn.knn_join_exact(rows, rows, 4, exclude_self=True)
    assert sorted(got.collect()) == sorted(exact.collect())
    slices = stored["visits"].selectExpr("cell >> 20 AS s").distinct().count()
    assert stored["visits"].count() > 20 * 900 * slices and stored["wanted"].count() == 900 * slices


def test_recall_is_measured_on_the_visits_of_the_joins(spark, small, monkeypatch):
    """Visits and buckets were calibrated, and leaves chosen, once for the share and once more for the join."""
    made = []
    for name in ("calibrate_cells", "calibrate_buckets", "_leaf_visits"):
        monkeypatch.setattr(knn, name, lambda *args, name=name, whole=getattr(knn, name), **options: made.append(name) or whole(*args, **options))
    assert {r.method for r in REGISTRY["knn_recall"].run(spark, small).collect()} == {"ivf", "lsh"}
    assert made.count("calibrate_cells") == made.count("_leaf_visits") == 1 and made.count("calibrate_buckets") <= 5
