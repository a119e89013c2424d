import random

import numpy as np
import pytest

from conftest import rows
from pairloom.operators import cluster, kmeans, noisy


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent}


def shapes():
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1001 + i) for i in range(300)]
    scattered = [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    return path + hub + [e for e in scattered if e[0] != e[1]]


def test_components_equal_union_find(spark):
    edges = shapes()
    got = cluster.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert set(rows(got)) == union_find(edges)


def test_components_of_a_long_chain_take_few_rounds(spark):
    n = 1000
    chain = list(range(2, n + 1)) + [1]  # the smallest id at the far end
    random.Random(9).shuffle(chain)
    got = cluster.connected_components(spark.createDataFrame(list(zip(chain, chain[1:])), "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == {(i, 1) for i in range(1, n + 1)}
    assert cluster.connected_components.rounds <= n.bit_length()


def test_components_of_nothing(spark):
    assert cluster.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_kmeans_chunks_cover_all_rows(spark):
    rng = random.Random(1)
    data = [(i, [float(i % 3 == c) + rng.random() * 0.1 for c in range(3)]) for i in range(90)]
    chunked = cluster.kmeans_chunks(spark.createDataFrame(data, "id long, v array<double>"), 3)
    groups = {}
    for r in chunked.collect():
        groups.setdefault(r.chunk, set()).add(r.id % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert chunked.count() == 90


def test_mini_batches_use_all_rows_and_averages_are_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6)) * 4
    data = centres[rng.integers(0, 5, 4000)] + rng.normal(size=(4000, 6)) * 0.2
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id long, v array<double>").repartition(6)
    fitted = kmeans.fit_centres(table, 5, 6, starts=3)
    at, away = kmeans.nearest(data, fitted)
    assert away.sum() < 1.1 * kmeans.nearest(data, centres)[1].sum() or len(set(at)) >= 3
    step = {r.centre: r for r in kmeans.one_pass(table, fitted[None], batch=None).collect()}
    assert sum(r.n for r in step.values()) == 4000
    for c, r in step.items():
        assert np.allclose(r.v, data[at == c].mean(0)) and np.isclose(r.cost, away[at == c].sum())
    few = kmeans.fit_centres(table.filter("id < 3"), 5, 6)
    assert len(few) == 3


def test_chunks_are_the_nearest_fitted_centres(spark):
    data = [(i, [float(i), 1.0]) for i in range(20)] + [(99, [1.0])]
    table = spark.createDataFrame(data, "id long, v array<double>")
    centres = np.array([[0.0, 1.0], [10.0, 1.0]])
    got = {r.id: r.chunk for r in cluster.kmeans_chunks(table, 2, centres=centres).collect()}
    assert got == {i: int(i > 5) for i in range(20)}


def test_noisy_pairs(spark):
    records = spark.createDataFrame(
        [(1, "a", 1), (2, "b", 1), (3, "b", 1), (4, "a", 2), (5, "b", 2), (6, "b", 3)], "id long, source string, cluster long")
    edges = spark.createDataFrame([(1, 2), (1, 4), (2, 5)], "src long, dst long")
    assert rows(noisy.cluster_negatives(edges, records)) == [(1, 4, 0.0), (2, 5, 0.0)]
    assert rows(noisy.cluster_positives(records, "a", "b")) == [(1, 2, 1.0), (1, 3, 1.0), (4, 5, 1.0)]
    mined = noisy.mine_noisy_pairs(records, edges, "a", "b")
    assert mined.filter("label = 1").count() == 2 and mined.filter("label = 0").count() == 2


def test_bootstrap_labels_near_copies(spark):
    rng = random.Random(8)
    data = []
    for group in range(6):
        centre = [rng.gauss(0, 1) for _ in range(12)]
        for side in "ab":
            data.append((len(data), side, [x + rng.gauss(0, 0.01) for x in centre]))
    records = spark.createDataFrame(data, "id long, source string, v array<double>")
    mined = noisy.bootstrap_noisy_labels(records, "a", "b", cutoff=0.95, k=3)
    positives = {(r.first_id, r.second_id) for r in mined.filter("label = 1").collect()}
    assert positives and positives <= {(i, i + 1) for i in range(0, 12, 2)}


@pytest.mark.parametrize("ties", [False, True])
def test_nearest_centroid_prefers_the_lowest_id_on_ties(spark, ties):
    centroids = spark.createDataFrame([(9, [1.0, 0.0]), (4, [1.0, 0.0] if ties else [0.0, 1.0])], "id long, v array<double>")
    rows_ = spark.createDataFrame([(1, [2.0, 0.1])], "id long, v array<double>")
    assert cluster.nearest_centroid(rows_, centroids).first()["centroid_id"] == (4 if ties else 9)
