import collections
import math

import numpy as np
import pytest

import shared
from pairloom.llm import katz


def plain(docs):
    """{position: (tokens, known, base, score)} by dictionaries; also checks that contexts sum to 1."""
    ones, twos, heads = collections.Counter(), collections.Counter(), collections.Counter()
    texts = []
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [*shared.words(lowered), "</s>"]
        texts.append(w)
        if not shared.held(doc_id, katz.FOLDS):
            ones.update(w)
            twos.update(zip(["<s>", *w], w))
            heads.update(["<s>", *w[:-1]])
    total, distinct = sum(ones.values()), len(ones)

    def cuts(counter):
        return katz.discounts(np.array([sum(c == r for c in counter.values()) for r in range(1, katz.K + 2)], float))

    d1, d2 = cuts(ones), cuts(twos)
    taken = lambda d, c: c * (d[c - 1] if c <= katz.K else 1.0)
    p = {w: taken(d1, c) / (total + 1) for w, c in ones.items()}
    unknown = 1 - sum(p.values())
    seen, low = collections.Counter(), collections.Counter()
    for (h, w), c in twos.items():
        seen[h] += taken(d2, c) / (heads[h] + 1)
        low[h] += p[w]
    weight = lambda h: (1 - seen[h]) / (1 - low[h])
    prob = lambda h, w: taken(d2, twos[h, w]) / (heads[h] + 1) if twos[h, w] else weight(h) * p.get(w, unknown)
    for h in list(seen)[:10]:
        assert math.isclose(sum(prob(h, w) for w in p) + weight(h) * unknown, 1, rel_tol=1e-9)
    out = []
    for w in texts:
        base = sum(math.log10((ones[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((len(w), sum(ones[x] > 0 for x in w), base, sum(math.log10(prob(h, x)) for h, x in zip(["<s>", *w], w))))
    return total, out


def compare(docs, rows):
    total, expected = plain(rows)
    got = katz.score_documents(docs).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} <= {total}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ours = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    theirs = sorted(((i, *e) for (i, _), e in zip(rows, expected)), key=key)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r.held_out == shared.held(r.doc_id, katz.FOLDS) for r in got)


def test_awkward_rows_equal_dictionaries(spark):
    compare(shared.clashing(shared.documents(spark)), [(r[0], r[1]) for r in shared.ROWS])


def test_given_documents_with_rare_words_and_many_partitions(spark, small, monkeypatch):
    """Few frequent words and small partitions send bigrams down every path."""
    monkeypatch.setattr(katz, "FREQUENT", 200)
    monkeypatch.setattr(katz, "HOTTEST", 8)
    monkeypatch.setattr(katz, "GROUP_TOKENS", 9000)
    monkeypatch.setattr(katz, "BATCH_CHARS", 100_000)
    docs = shared.given(spark, small)
    compare(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows_and_no_training_rows(spark):
    assert katz.score_documents(shared.documents(spark, [])).count() == 0
    only = next(i for i in range(100) if shared.held(i, katz.FOLDS))
    row = katz.score_documents(shared.documents(spark, [(only, "a b", None, None, None)])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_packed_arrays_come_back():
    a, b = np.arange(5) * 10**12, np.array([1, 2, 3, 255, 0], np.uint8)
    assert [x.tolist() for x in katz.unpack(katz.pack(a, b), 5, "i8", "u1")] == [a.tolist(), b.tolist()]
    assert [len(x) for x in katz.unpack(katz.pack(a[:0], b[:0]), 0, "i8", "u1")] == [0, 0]
