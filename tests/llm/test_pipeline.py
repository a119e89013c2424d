"""The pipeline against each stage's brute-force version over that stage's own input."""

import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
import shared
from pairloom.llm import pii, quality
from test_line_rules import verdicts
from test_minhash import classes


def test_stages_follow_from_each_other(spark, small):
    docs = shared.given(spark, small)
    columns = docs.columns
    outs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        outs.append([tuple(r) for r in docs.collect()])
    given = [tuple(r) for r in shared.given(spark, small).collect()]
    good, ruled, single, private = outs

    model = quality.train_ranking(shared.given(spark, small), shared.given(spark, small, "labels"))
    scores = model.score(np.array([quality.text_features(r[1]) for r in given]))
    assert sorted(good) == sorted(r for r, s in zip(given, scores) if s >= quality.CUT) and len(good) < len(given)

    kept = [r for r, v in zip(good, verdicts(good, 20, 0.0)) if v[-1]]
    assert sorted(r[0] for r in ruled) == sorted(r[0] for r in kept) and len(ruled) < len(good)

    groups = collections.defaultdict(list)
    for r, c in zip(ruled, classes(ruled)):
        groups[c].append(r)
    assert len(single) == len(groups) and {r[0] for r in single} == set(groups) and set(single) <= set(ruled)

    texts = {r[0]: r[1] for r in private}
    assert len(private) == len(single)
    for r in single:
        assert (texts[r[0]] == r[1]) == (not pii.base_spans(r[1]))
        assert not pii.base_spans(texts[r[0]])

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array(model.encode(r[1], add_special_tokens=False).ids + [0], "<u4") for r in private}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)

    whole = corpus_pipeline.run(spark, small).collect()
    key = lambda p: (p.doc_id, p.start)
    assert {p.doc_id: p.doc_tokens for p in whole} == {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in whole) == sum(p.length for p in pieces) and sorted(whole, key=key)


def test_an_empty_table_passes_every_stage(spark, small):
    docs = shared.given(spark, small).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_a_group_of_near_copies_leaves_one_text(spark, small):
    """Rules and dedup over near copies that keep most lines, and over texts that only share a notice."""
    line = lambda name, k: " ".join(f"{name}{k}x{j}" for j in range(12))
    base = [line("same", k) for k in range(30)]
    rows = []
    for i in range(40):
        lines = list(base)
        lines[i % 30] = line(f"own{i}", 0)
        rows.append((i, "\n".join(lines), "en", "h", 0))
    notice = "all rights reserved by the house"
    rows += [(100 + i, "\n".join([*(line(f"text{i}", k) for k in range(6)), notice]), "en", "h", 0) for i in range(160)]
    docs = shared.documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {i for i in texts if i < 100}
    assert found == {min(classes(rows[:40]))} and all(texts[i] == rows[i][1] for i in found)
    assert len(texts) == 161 and not any(notice in t for t in texts.values())
