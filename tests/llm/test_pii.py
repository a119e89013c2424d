import hashlib

import pytest
from pyspark.sql import functions as F

import shared
from pairloom.llm import pii, queries

MAIL, CARD = "jo.x%1@mail-a.example.org", "4111 1111 1111 1111"


@pytest.mark.parametrize(
    "text, spans",
    [
        ("", []), ("no data 12345", []), (f"a {MAIL}, b", [(2, 0, 2 + len(MAIL))]), ("é😀 a@b.c", [(3, 0, 8)]), ("a@b", []),
        ("1.2.3.4", [(0, 1, 7)]), ("256.1.1.1 1.1.1.1", [(10, 1, 17)]), ("001.2.3.4.5", [(0, 1, 9)]), ("1.2.3.4567", []),
        (CARD, [(0, 2, 19)]), ("4111-1111-1111-1112", []), ("4111  1111 1111 1111", []),
        ("+49 (30) 1234-567", [(0, 3, 17)]), ("+1 2", []), ("+1 " + "9" * 15, []),
        ("+4111111111111111", [(1, 2, 17)]), ("x+44 20 7946 0958 y", [(1, 3, 17)]),
    ],
)
def test_base_patterns(text, spans):
    assert pii.base_spans(text) == spans


def seeded(n=12):
    rows = [(i, f"filler{i} dial extension {400000000 + i} +1 555 010 {1000 + i} today", "en", "s", 0) for i in range(3)]
    rows += [(100 + i, f"text{i} please call account +1 555 010 {2000 + i} before noon, fine", "en", "s", 0) for i in range(n)]
    return rows + [(500, "more: please call account ACC99812345 before noon, fine", "en", "s", 0), (501, "call ACC99812345 now or later", "en", "s", 0)]


def test_patterns_discover_unseen_identifiers(spark):
    got = {r.doc_id: r for r in pii.find_personal_data(shared.documents(spark, seeded())).collect()}
    assert [tuple(s) for s in got[500].added] == [(26, 3, 37)]
    assert not any(r.added for i, r in got.items() if i != 500)


def test_scores_equal_a_plain_computation(spark):
    rows = seeded(6)
    found = pii.extract(shared.documents(spark, rows), "doc_id", "text")
    edges = {}
    for _, text, *_ in rows:
        for _, _, kind, instance, patterns in pii.candidates(text, pii.base_spans(text)):
            for p in patterns:
                edges[p, instance] = max(kind, edges.get((p, instance), -1))
    seeds = {p: sum(k >= 0 for (q, _), k in edges.items() if q == p) for p, _ in edges}
    edges = {e: k for e, k in edges.items() if seeds[e[0]] >= 3}
    belief = {i: 0.0 for _, i in edges} | {i: 1.0 for (_, i), k in edges.items() if k >= 0}
    for _ in range(pii.ROUNDS):
        score = {}
        for p in {p for p, _ in edges}:
            own = [belief[i] for q, i in edges if q == p]
            score[p] = sum(own) / (len(own) + pii.DOUBT)
        for i in belief:
            if not any(k >= 0 for (_, j), k in edges.items() if j == i):
                miss = 1.0
                for p, j in edges:
                    miss *= 1 - score[p] if j == i else 1
                belief[i] = 1 - miss
    got = {r.pattern: r.score for r in pii.confident_patterns(found, support=3, confident=0.0).collect()}
    assert got == pytest.approx(score) and len(got) > 1


def test_clean_texts_get_nothing(spark, small):
    docs = shared.given(spark, small)
    for row in pii.find_personal_data(docs).collect():
        assert not row.added or row.base


def test_awkward_rows_and_query(spark):
    more = [(20, f"mail {MAIL} or 1.2.3.4", None, None, None), (20, f"mail {MAIL} or 1.2.3.4", None, None, None)]
    docs = shared.clashing(shared.documents(spark, shared.ROWS + more))
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(shared.ROWS) + 2 and sum(len(r.base) for r in got) == 4
    assert pii.find_personal_data(shared.documents(spark, [])).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(shared.ROWS) + 2
    texts = [r.text for r in clean.where("doc_id = 20").collect()]
    assert texts == ["mail [email] or [ip]"] * 2
    assert {(r.text, r.n_chars) for r in clean.where("doc_id = 20").collect()} == {(texts[0], len(texts[0]))}
    assert clean.where("text is null").count() == 1


def test_digest_columns(spark, small):
    got = queries.op7_pii(spark, small).where("n_email + n_ip + n_card + n_phone > 0").collect()
    texts = {r.doc_id: r.text for r in shared.given(spark, small).collect()}
    for r in got:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(","))
    assert queries.op7_pii(spark, small).where(F.col("spans") == "").count() > 0
