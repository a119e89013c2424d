import collections
import random
import zlib

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

import shared
from pairloom.llm import packing, words
from pairloom.llm.words import WordEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, window=packing.WINDOW, **settings):
    model = Tokenizer.from_file(PATH)
    ids = [np.array(e.ids + [0], "<u4") for e in model.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    got = packing.pack_documents(docs, PATH, public_tokenizers.PATTERN, window=window).collect()
    sequences, places = collections.defaultdict(list), collections.Counter()
    expected = collections.defaultdict(list)
    for (name, _), own in zip(rows, ids):
        expected[name].append(own)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        fitting = [o for o in expected[r.doc_id] if len(o) == r.doc_tokens and zlib.crc32(o[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert fitting and r.length > 0
        for i in range(r.start, r.start + r.length):
            places[r.doc_id, r.doc_tokens, i] += 1
    needed = collections.Counter((name, len(o), i) for name, own in expected.items() for o in own for i in range(len(o)))
    assert places == needed
    short = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        short += end < window
    return short


def test_awkward_rows(spark):
    assert check(shared.clashing(shared.documents(spark)), [(r[0], r[1]) for r in shared.ROWS]) <= 1
    assert packing.pack_documents(shared.documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


SPACED = [
    (30, "  two  spaces\n\n\tand tabs \r\n x", "en", "a", 0),
    (31, "lines\nof words, don't\n\nthey're 12 345 end\n", "en", "a", 0),
    (32, "a\u00a0b \u00a0c \u2003 d\u3000e\x1ff \x85g", "en", "a", 0),
    (33, "before<|endoftext|>after <|endoftext|> and  more<|endoftext|>", "en", "a", 0),
    (34, "<|endoftext|>", "en", "a", 0),
    (35, " lead and trail ", "en", "a", 0),
    (36, "x" * 1500 + " " + "é" * 700, "en", "a", 0),
]


def test_words_are_encoded_as_the_library_does(spark):
    model = Tokenizer.from_file(PATH)
    encoder = WordEncoder(PATH, public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = [r[1] or "" for r in shared.ROWS + SPACED]
    texts += ["".join(rng.choice(["a", "Bc", " ", " ", "\n", "  ", "'s", "1", "!", "é", "\t", "<|endoftext|>"]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += [r.text or "" for r in shared.given(spark, "/root/testdata/sf0.01").collect()]
    for batch in (texts, texts[::-1]):
        ids, counts = encoder.encode(batch)
        ends = np.cumsum(counts)
        for text, wanted, a, b in zip(batch, model.encode_batch(batch, add_special_tokens=False), ends - counts, ends):
            assert wanted.ids == ids[a:b].tolist(), text


def test_special_tokens_and_uneven_spaces(spark):
    check(shared.documents(spark, SPACED), [(r[0], r[1]) for r in SPACED])


def test_given_documents_in_small_windows_and_shards(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    docs = shared.given(spark, small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(docs, rows, window=256) <= 2 * (len(rows) // 64 + 1)


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 50, rng.integers(5, 60)).astype(np.int32) for _ in range(40)]
    n, mean = len(tails), np.mean([len(t) for t in tails])
    df = np.array([sum(t in set(x.tolist()) for x in tails) for t in range(50)])
    idf = packing.idf_of(df, n)
    shard = packing.Shard(tails, idf, mean)

    def weight(term, tail):
        tf = int((tail == term).sum())
        return idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(tail) / mean))

    query = sorted(set(tails[0].tolist()), key=lambda t: (-weight(t, tails[0]), t))[: packing.QUERY_TERMS]
    scores = np.array([sum(weight(t, tail) for t in query) for tail in tails])
    unused = np.ones(n, bool)
    unused[[0, 5]] = False
    got = shard.neighbours(0, unused)
    assert not set(got) & {0, 5}
    assert np.allclose(scores[got], np.sort(scores[unused & (scores > 0)])[::-1])


def test_a_seed_takes_its_like_first():
    a, b = np.arange(10, 40, dtype=np.int32), np.arange(100, 130, dtype=np.int32)
    tails = [a, b, b.copy(), a.copy()]
    idf = packing.idf_of(np.full(200, 2), 4)
    windows = packing.pack_shard(tails, idf, 30.0, 60)
    assert [[p[0] for p in w] for w in windows] == [[0, 3], [1, 2]]


def test_uneven_is_white_space_at_an_end_or_beside_a_space():
    meant = regex.compile(r"\A\s|\s\Z| \s|\s ")
    spaces = [c for c in map(chr, range(0x3100)) if regex.match(r"\s", c)]
    texts = ["", "a", "a b", *(t for c in spaces for t in (f"é{c}b", f"é{c} b", f"a {c}b", f"{c}a", f"é{c}"))]
    assert [words.uneven(t) for t in texts] == [meant.search(t) is not None for t in texts]
