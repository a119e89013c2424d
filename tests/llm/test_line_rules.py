import collections
import re

import shared
from pairloom.llm import line_rules


def counts(text):
    w = shared.words(text)
    lines = [x for x in (text or "").split("\n") if shared.words(x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if windows[t] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def normal(text):
    lines = (re.sub(r"[ \t\x0b-\r]+", " ", x).strip(" ").lower() for x in (text or "").split("\n"))
    return [x for x in lines if x]


def verdicts(rows, floor, share, kept_share=line_rules.KEPT_SHARE):
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r[3] or ""].add(r[1] or "")
    out = []
    for r in rows:
        own = texts[r[3] or ""]
        often = collections.Counter(line for t in own for line in set(normal(t)))
        gone = sum(len(line.split(" ")) for line in normal(r[1]) if often[line] > max(floor, share * len(own)))
        c = counts(r[1])
        out.append((r[0], *c, gone, not c[-1] and c[0] - gone >= kept_share * c[0]))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]


def check(docs, rows, floor, share):
    got, _ = line_rules.score_rules(docs, floor=floor, share=share)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == sorted(verdicts(rows, floor, share), key=repr)


def crowd():
    notice = "Read   our TERMS and\tconditions before you go on"
    body = lambda i, n: "\n".join(" ".join(f"t{i}w{j}" for j in range(k, k + 10)) for k in range(0, n, 10))
    rows = [(i, f"{body(i, 60)}\n{notice}", "en", "h", 0) for i in range(8)]
    rows += [(20 + i, "\n".join([body(20 + i, 30), *[notice.lower()] * 5]), "en", "h", 0) for i in range(2)]
    rows += [(30, f"{body(30, 60)}\n{notice}", "en", "other", 0), (31, body(31, 70), "en", "h", 0)]
    return rows + [rows[0]] * 5  # copies of one text count once


def test_awkward_rows(spark):
    check(shared.clashing(shared.documents(spark)), shared.ROWS, 1, 0.1)
    got, removed = line_rules.score_rules(shared.documents(spark, []))
    assert got.count() == removed.count() == 0


def test_lines_over_the_limit_go(spark):
    rows = crowd()
    docs = shared.documents(spark, rows)
    check(docs, rows, 3, 0.1)
    out = line_rules.apply_rules(shared.clashing(docs), floor=3, share=0.1)
    assert out.columns == shared.clashing(docs).columns
    kept = {r[0] for r in verdicts(rows, 3, 0.1) if r[-1]}
    got = out.collect()
    assert {r.doc_id for r in got} == kept and len(got) == sum(r[0] in kept for r in rows) and not kept & {20, 21}
    for r in got:
        assert ("TERMS" in r.text) == (r.doc_id == 30)
        assert r.n_chars == (len(r.text) if r.doc_id < 20 else 0)


def test_the_limit_is_the_same_in_small_and_large_hosts(spark):
    body = lambda i: "\n".join(" ".join(f"t{i}w{j}" for j in range(k, k + 10)) for k in range(0, 60, 10))
    notice, rare = "all rights reserved by the house", "seen in twenty texts"
    rows = []
    for host, size in (("small", 40), ("large", 400)):
        for i in range(size):
            lines = [body(f"{host}{i}"), *[notice] * (i < 21), *[rare] * (i < 20)]
            rows.append((len(rows), "\n".join(lines), "en", host, 0))
    docs = shared.documents(spark, rows)
    got, _ = line_rules.score_rules(docs)
    removed = {r.doc_id: r.n_removed_words for r in got.collect()}
    assert removed == {r[0]: 6 * (notice in r[1]) for r in rows}
    out = line_rules.apply_rules(docs).collect()
    assert len(out) == len(rows) and not any(notice in r.text for r in out) and sum(rare in r.text for r in out) == 40


def test_given_documents(spark, small):
    docs = shared.given(spark, small)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    check(docs, rows, 2, 0.0)


def test_no_python_in_the_plan(spark, small):
    got, _ = line_rules.score_rules(shared.given(spark, small))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
