import numpy as np
import pytest

import shared
from pairloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=ed.COSINE):
    ok = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    units = {i: u / np.abs(u).max() for i, u in units.items()}
    units = {i: u / np.sqrt((u * u).sum()) for i, u in units.items()}
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()] - seen:
                seen.add(j)
                open_.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def run(spark, rows):
    got = ed.near_equal_vectors(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def groups(n, width=16, seed=2, spread=0.03):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(n // 6, width))
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=width) * spread * rng.integers(0, 5)
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("tile", [8, 512])
def test_links_and_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "TILE", tile)
    rows = groups(300)
    expected = brute(rows)
    assert sum(r[1] for r in expected) > 100 and run(spark, rows) == expected


def test_awkward_vectors(spark):
    a = [1.0, 2.0, 3.0, 0.5]
    rows = [
        (5, a, 1), (3, a, 1), (3, a, 1), (4, a, 2), (None, a, 1), (7, a, None), (8, None, 1), (9, [0.0] * 4, 1), (10, [], 1),
        (11, [1.0, None, 0.0, 0.0], 1), (12, [float("nan"), 1.0, 1.0, 1.0], 1), (13, [float("inf"), 1.0, 1.0, 1.0], 1),
        (14, [x * 1e30 for x in a], 1), (15, [x * 1e-30 for x in a], 1), (16, [1.0, 2.0], 1), (17, [2.0, 4.0], 1), (18, [-x for x in a], 1),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_other_columns_do_not_matter(spark):
    rows = groups(40)
    docs = shared.clashing(spark.createDataFrame(rows, SCHEMA))
    assert ed.near_equal_vectors(docs).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_early_stops_lose_no_pair():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 40)) * np.geomspace(4, 0.05, 40)
    a = np.concatenate([base, base[:20] + rng.normal(size=(20, 40)) * 0.02])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    for cosine in (0.5, 0.9, 0.98):
        i, j = ed.tile_links(a, a, turn, cosine, True)
        expected = np.argwhere(np.triu(a @ a.T >= cosine, 1))
        assert sorted(zip(i.tolist(), j.tolist())) == [tuple(x) for x in expected.tolist()]
        i, j = ed.tile_links(a[:30], a[30:], turn, cosine, False)
        assert sorted(zip(i.tolist(), j.tolist())) == [tuple(x) for x in np.argwhere(a[:30] @ a[30:].T >= cosine).tolist()]


def test_forest_labels_components():
    assert ed.forest(np.array([0, 3, 4]), np.array([5, 4, 1]), 6).tolist() == [0, 1, 2, 1, 1, 0]
