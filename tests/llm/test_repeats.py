import collections
import hashlib
import random

import numpy as np
import pytest
import shared
from pairloom.llm import bwt, repeats


def found_twice(strings, width):
    counts = collections.Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
    return [(k, i) for k, s in enumerate(strings) for i in range(len(s) - width + 1) if counts[s[i : i + width]] > 1]


def plain(rows, width):
    bodies = [(r[1] or "").encode() for r in rows]
    covered = [bytearray(len(b)) for b in bodies]
    for k, i in found_twice(bodies, width):
        covered[k][i : i + width] = b"\1" * width
    for (doc_id, *_), body, marks in zip(rows, bodies, covered):
        kept = bytes(b for b, m in zip(body, marks) if not m)
        runs = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
        yield doc_id, len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()


def check(docs, rows, width, **settings):
    got = repeats.remove_repeats(docs, width=width, **settings)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == sorted(plain(rows, width), key=repr)
    return got


def test_merged_transforms_find_what_occurs_twice():
    rng = random.Random(1)
    for _ in range(150):
        width = rng.choice([1, 2, 3, 4, 5, 7, 8, 12, 13])
        strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 9))]
        string, offset = bwt.repeated_rows(strings, width, rng.choice([1, 10, 40, 1000]))
        assert list(zip(string.tolist(), offset.tolist())) == found_twice(strings, width)


def test_a_transform_steps_through_its_texts_and_the_merge_is_sorted():
    rng = random.Random(2)
    texts = [[bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(3)] for _ in range(4)]
    shards = [bwt.build_shard(t) for t in texts]
    for own, shard in zip(texts, shards):
        step, symbol = np.argsort(shard.bwt, kind="stable"), np.sort(shard.bwt)
        for row in range(len(symbol)):
            if symbol[row]:
                assert own[shard.string[row]][shard.offset[row]] == symbol[row] - 1
                assert (shard.string[step[row]], shard.offset[step[row]]) == (shard.string[row], shard.offset[row] + 1)
    order, block = bwt.merge_shards(shards, 6)
    heads = [own[s][o : o + 6] for own, shard in zip(texts, shards) for s, o in zip(shard.string, shard.offset)]
    full = [heads[i] for i in order if len(heads[i]) == 6]
    assert full == sorted(full) and np.all(np.diff(block[order]) >= 0)
    assert all((block[i] == block[j]) == (heads[i] == heads[j]) for i in order for j in order if len(heads[i]) == len(heads[j]) == 6)


@pytest.mark.parametrize("limit", [2048, 0])
def test_awkward_rows(spark, limit):
    rows = [*shared.ROWS, (30, "ab" * 900, "en", "a", 0), (31, "x" * 401, "en", "a", 0), (32, "é" * 199 + "y", "en", "a", 0), (33, "z" * 400, "en", "a", 0)]
    got = check(shared.clashing(shared.documents(spark, rows)), rows, 400, merged_pieces=limit)
    lost = {r[0]: r[2] for r in got}
    assert lost[30] == 1800 and lost[31] == 401 and lost[32] == lost[33] == 0 and lost[8] == 108000
    assert repeats.remove_repeats(shared.documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [2048, 3, 0])
def test_random_passages(spark, limit):
    rng = random.Random(limit)
    passages = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 150))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if rng.random() < 0.2 and text:
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        rows.append((i, text, "en", "a", 0))
    got = check(shared.documents(spark, rows), rows, 40, gram=8, merged_pieces=limit)
    assert 20 < sum(r[2] > 0 for r in got) < 160


def test_a_passage_in_every_document(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))
    rows = [(i, noise() + passage + noise(), "en", "a", 0) for i in range(150)]
    for limit in (2048, 20):
        got = check(shared.documents(spark, rows), rows, 60, gram=12, merged_pieces=limit)
        assert all(130 <= r[2] <= 140 for r in got)


def test_given_documents_and_what_is_kept(spark):
    docs = shared.given(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(docs, rows, 400)
    assert sum(r[2] for r in got) > 1000
    full = {r.doc_id: r for r in repeats.remove_repeats(docs, with_text=True).collect()}
    for doc_id, text in rows:
        body, r = (text or "").encode(), full[doc_id]
        for a, b in reversed(r.spans):
            body = body[:a] + body[b:]
        assert body == bytes(r.kept) and hashlib.sha256(body).hexdigest() == r.kept_sha256
