import random

import numpy as np
import pytest

import shared
from pairloom.llm import minhash


def sets(text):
    w = shared.words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """Least id of each row's class, by comparing all pairs."""
    held = [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(held):
        for j in range(i):
            b = held[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    return [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))]


def check(docs, rows):
    got = minhash.near_copies(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(zip((r[0] for r in rows), classes(rows)), key=key)
    parts = {}
    for r in got:
        parts.setdefault(r.class_id, []).append(r.kept)
    return got, parts


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def test_shingles_equal_plain_sets():
    texts = [r[1] or "" for r in shared.ROWS]
    owner, value, times = minhash.shingles(texts)
    for i, text in enumerate(texts):
        own = owner == i
        assert len(set(value[own].tolist())) == own.sum() == len(sets(text))
        assert times[own].sum() == max(0, min(1, len(shared.words(text))) * max(1, len(shared.words(text)) - 4))


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_probability_jaccard(weighted):
    rng = np.random.default_rng(11)
    value = rng.integers(1, 2**62, 300).astype(np.uint64)
    weight = rng.gamma(1.0, 2.0, 300) + 0.1 if weighted else np.ones(300)
    a, b = np.arange(0, 220), np.arange(80, 300)
    text = np.r_[np.zeros(220, int), np.ones(220, int)]
    sig = minhash.signatures(text, np.r_[value[a], value[b]], np.r_[weight[a], weight[b]], 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = weight[a] / weight[a].sum(), weight[b] / weight[b].sum()
    both = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * (exact * (1 - exact) / 4096) ** 0.5


def test_early_stop_does_not_change_a_signature():
    """Against all arrivals of every shingle, one text alone and two together."""
    value = np.arange(1, 8, dtype=np.uint64) * np.uint64(10**15)
    weight, m = np.linspace(0.5, 3, 7), 16
    alone = minhash.signatures(np.zeros(7, int), value, weight, 1, m)
    together = minhash.signatures(np.r_[np.zeros(7, int), np.ones(3, int)], np.r_[value, value[:3]], np.r_[weight, weight[:3]], 2, m)
    clock, first, winner = np.zeros(7), np.full(m, np.inf), np.zeros(m, np.uint64)
    for turn in range(1, 400):
        with np.errstate(over="ignore"):
            dice = minhash.mix(value + np.uint64(turn) * np.uint64(0xD1342543DE82EF95))
        clock = clock - np.log(((dice >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        for i, cell in enumerate(minhash.mix(dice) % np.uint64(m)):
            if clock[i] < first[int(cell)]:
                first[int(cell)], winner[int(cell)] = clock[i], value[i]
    assert alone[0].tolist() == together[0].tolist() == winner.tolist()


def test_awkward_rows(spark):
    docs = shared.clashing(shared.documents(spark))
    got, parts = check(docs, shared.ROWS)
    assert all(sum(kept) == 1 for c, kept in parts.items())
    out = minhash.drop_near_copies(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in got)
    assert minhash.near_copies(shared.documents(spark, [])).count() == 0


def test_a_crowd_of_edited_copies_and_chains(spark):
    """Many variants around a centre (not all similar to each other), chains of edits, and stragglers."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000 + i, edited(rng, base, rng.randrange(0, 9)), "en", "s", 0) for i in range(120)]
    rows.append((2000, " ".join(base), "en", "s", 0))
    walk = [f"v{i}" for i in range(120)]
    for i in range(25):
        walk = edited(rng, walk, 1).split()
        rows.append((3000 - i, " ".join(walk), "en", "s", 0))
    rows += [(4000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)), "en", "s", 0) for i in range(20)]
    _, parts = check(shared.documents(spark, rows), rows)
    assert len(parts) > 21 and all(sum(k) == 1 for k in parts.values())


def test_given_documents(spark, small):
    docs = shared.given(spark, small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)


def test_without_python_the_classes_are_the_same(spark, small):
    for docs in (shared.given(spark, small), shared.documents(spark)):
        same = [sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_copies(docs, native=n).collect()) for n in (False, True)]
        assert same[0] == same[1]


def test_repeated_passages_do_not_lower_the_agreement(spark):
    """A passage 50 times in one text only; one-row bands agree as often as the Jaccard similarity says."""
    words = [f"w{i}" for i in range(800)]
    rows = [(1, " ".join(words[:270] * 49 + words + [f"a{i}" for i in range(90)])), (2, " ".join(words + [f"b{i}" for i in range(90)]))]
    a, b = (sets(text) for _, text in rows)
    exact = len(a & b) / len(a | b)
    got = minhash.sketch(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2048, 1).collect()
    agreed = (np.array(got[0].bands) == np.array(got[1].bands)).mean()
    assert exact > 0.79 and abs(agreed - exact) < 4 * (exact * (1 - exact) / 2048) ** 0.5


@pytest.mark.parametrize("native", [False, True])
def test_a_crowd_without_links_is_not_compared_pair_by_pair(spark, monkeypatch, native):
    """Texts that share buckets and every shingle with some other text, no two of them similar."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        changed = {b: rng.randrange(3) for b in rng.sample(range(40), 4)}
        rows.append((i, " ".join(f"b{b}v{changed.get(b, 'x')}w{j}" for b in range(40) for j in range(6)), "en", "s", 0))
    rows += [(1000 + i, rows[i][1].replace("b7vxw3", "other"), "en", "s", 0) for i in range(5)]
    compared, real = [], minhash.materialize

    def stored(df, name):
        out = real(df, name)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", stored)
    got = minhash.near_copies(shared.documents(spark, rows), native=native).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == classes(rows)
    assert len(compared) > 1 and sum(compared[1:]) < len(rows)


def test_sketches_never_rule_out_a_link(spark):
    """Bits that differ are at most as many as shingles that do, and of the same parity."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(rng, base, n) for n in (0, 1, 2, 5, 40)] + ["", "one two"]
    held = [minhash.shingles([text])[1].view(np.int64).tolist() for text in texts]
    rows = spark.createDataFrame([(i, v) for i, values in enumerate(held) for v in values], "node long, shingle long")
    found = {r.node: [r[f"s{i}"] % 2**64 for i in range(minhash.SKETCH)] for r in minhash.parity_sketches(rows).collect()}
    for i, a in found.items():
        for j, b in found.items():
            bits, apart = sum((x ^ y).bit_count() for x, y in zip(a, b)), len(set(held[i]) ^ set(held[j]))
            assert bits <= apart and (bits - apart) % 2 == 0
