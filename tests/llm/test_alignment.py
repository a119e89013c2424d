import bisect
import collections
import hashlib

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import shared
from pairloom.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (20, "a <|endoftext|> b <s> </s> <unk> <0x41>", "en", "a", 0),
    (21, "under ▁ score", "en", "a", 0),
    (22, "  two  spaces\n\n\tand tabs \r\n ", "en", "a", 0),
    (23, "x" * 1500 + " " + "é" * 700, "en", "a", 0),
    (24, " ", "en", "a", 0),
    (25, "\x00 nul ﻿ mark ﬁ ligature Å", "en", "a", 0),
]


def both_sides(texts):
    """(id, bytes) of each text's tokens on both sides, by the installed libraries; empty where they do not spell it."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    letters = alignment.byte_letters()
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    for text in texts:
        sides = [], []
        if text:
            found = tokenizer.encode(" " + text, add_special_tokens=False)
            sides = (
                [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in found.ids],
                [(i, alignment._piece_bytes(model.id_to_piece(i))) for i in model.encode(text)],
            )
            if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
                sides = [], []
        yield sides


def plain(rows):
    """What the query returns, by dictionaries."""
    out, linked = [], []
    for (doc_id, *_), (a, b) in zip(rows, both_sides([r[1] for r in rows])):
        ends = [{}, {}]
        for side, tokens in zip(ends, (a, b)):
            end = 0
            for i, t in tokens:
                end += len(t)
                side[end] = i
        cuts = sorted(set(ends[0]) & set(ends[1]))
        members = [collections.defaultdict(list) for _ in ends]
        for side, found in zip(ends, members):
            for end, i in side.items():
                found[bisect.bisect_left(cuts, end)].append(str(i))
        groups = ["|".join(",".join(found[g]) for found in members) for g in range(len(cuts))]
        linked.append([(ends[0][c], ends[1][c]) for c in cuts])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(cuts), len(cuts), digest))
    counts = collections.Counter(pair for pairs in linked for pair in pairs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (*row[:5], sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), row[5])
        for row, pairs in zip(out, linked)
    ]


def aligned(docs, **settings):
    got = alignment.align_documents(docs, A, public_tokenizers.PATTERN, B, **settings)
    assert got.columns == alignment.COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_awkward_rows_equal_brute_force(spark, limit):
    rows = shared.ROWS + ODD
    got = aligned(shared.clashing(shared.documents(spark, rows)), broadcast_pairs=limit)
    assert got == sorted(plain(rows), key=repr)
    zeros = {r[0] for r in got if not any(r[1:7]) and r[7] == ""}
    assert zeros >= {4, 5, 21}


def test_empty_table_and_tables_without_tokens(spark):
    for limit in (10**6, 0):
        assert aligned(shared.documents(spark, []), broadcast_pairs=limit) == []
        assert aligned(shared.documents(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0)]), broadcast_pairs=limit) == [
            (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_given_documents_equal_brute_force(spark):
    docs = shared.given(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert aligned(docs) == sorted(plain(rows), key=repr)


def test_overlaps_are_all_pairs_that_meet():
    frame = lambda lengths: pd.DataFrame({"doc": sum(([d] * len(x) for d, x in enumerate(lengths)), []), "n": sum(lengths, [])})
    a, b = frame([[3, 1, 2], [], [1, 1]]), frame([[1, 1, 4], [], [2]])
    for f in (a, b):
        f["end"] = f.n.cumsum()
        f["start"] = f.end - f.n
    got = sorted((x, y) for _, x, y in alignment.overlaps(a, b).itertuples(index=False))
    meet = lambda x, y: x.doc == y.doc and x.start < y.end and y.start < x.end
    assert got == [(i, j) for i, x in enumerate(a.itertuples()) for j, y in enumerate(b.itertuples()) if meet(x, y)]


def test_pairs_that_overflow_a_task_are_still_summed(spark, monkeypatch):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(["the cat sat", "the cat ran off", "the dog"] * 5)]
    whole = aligned(shared.documents(spark, rows))
    assert whole == sorted(plain(rows), key=repr)
    monkeypatch.setattr(alignment, "SUMMED", 2)
    assert aligned(shared.documents(spark, rows)) == whole
