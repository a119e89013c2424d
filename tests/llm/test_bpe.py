import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import shared
from pairloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(PATH).ids
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    letters = "abcdeABC éßñ漢字😀 \t\n\r\x0b\x0c\x1c\x85\xa0​0123٣½'sré!?#_-\U0001f1e6́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 2500, "thequickbrown" * 300, "漢" * 900, "", "<|endoftext|>", *filter(None, (r[1] for r in shared.ROWS))]
    encoder = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for part in (texts[:700], texts[700:]):  # the second meets pieces of the first again
        ids, counts = encoder.encode(part)
        assert split(ids, counts) == [library.encode_ordinary(t) for t in part]
        assert encoder.ranks.decode(ids).tobytes() == "".join(part).encode()


def test_long_pieces_agree_with_rows(monkeypatch):
    ranks = bpe.load_ranks(PATH)
    pieces = [p.encode() for p in ("internationalisation" * 3, "x" * 90, "antidisestablishment")]
    by_rows = ranks.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "BUCKETS", (4,))
    by_heap = ranks.encode_pieces(pieces)
    assert [x.tolist() for x in by_rows] == [x.tolist() for x in by_heap]


def test_memory_of_pieces_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for text in (shared.PROSE, shared.NEAR, "short"):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert len(encoder.codes) < 10


def test_operator(spark, library):
    docs = shared.clashing(shared.documents(spark))
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()

    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        return doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest(), tuple(ids)

    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((*r[:4], tuple(r.ids)) for r in got), key=key) == sorted((row(r[0], r[1]) for r in shared.ROWS), key=key)
    assert bpe.encode_documents(shared.documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
