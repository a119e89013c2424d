"""Encoding by whole words: a text is cut at its spaces and marks first, and each distinct word is split by the pattern once.

A space between two other characters than white space always begins a match of the splitting
pattern, and no match runs over it. So the ids of such a text are those of its words, each with
the space before it and without the marks around it. A text with a space beside other white space goes through the pattern as a whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

from pairloom.llm.alignment import load_byte_level
from pairloom.llm.bpe import Encoder, ragged
from pairloom.llm.repeats import Rolling

#: Distinct words a worker remembers.
REMEMBERED = 1_000_000
#: White space but spaces, and each of it beside a space.
_PAIRS = [(c, f" {c}", f"{c} ") for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]
#: ASCII letters and digits, marks, and white space but spaces. A match of the pattern also ends between a letter or
#: digit and what follows of the other two, and between a mark and a letter or digit; an apostrophe may join.
_ALNUM, _MARK, _WHITE = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[b for b in range(128) if chr(b).isalnum()]] = _ALNUM
_KIND[39] = 0
_KIND[[9, 10, 11, 12, 13]] = _WHITE
#: Words that are one match of the pattern.
_ONE = regex.compile(r" ?\p{L}+")


def uneven(text: str) -> bool:
    """Whether white space is at an end of the text, or a space beside white space."""
    return text != text.strip() or "  " in text or any(c in text and (before in text or after in text) for c, before, after in _PAIRS)


class WordEncoder:
    """Encodes batches of texts by a byte-level tokenizer file; strings of special tokens get their ids."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pieces = Encoder(load_byte_level(path), pattern)
        with open(path, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file).get("added_tokens") or []}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
                if part:
                    parts.append(part)
                    owner.append(i)
        kind = np.fromiter((0 if p in self.special else 1 if uneven(p) else 2 for p in parts), np.int64, len(parts))
        chosen = [[p for p, k in zip(parts, kind) if k == own] for own in range(3)]
        special = np.array([self.special[p] for p in chosen[0]], np.int32)
        found = [(special, np.ones(len(special), np.int64)), self.pieces.encode(chosen[1]), self._encode_even(chosen[2])]
        counts, starts, before = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for own, (ids, n) in enumerate(found):
            counts[kind == own], starts[kind == own] = n, before + np.cumsum(n) - n
            before += len(ids)
        ids = np.concatenate([ids for ids, _ in found])
        return ids[ragged(starts, counts)], np.bincount(np.array(owner, np.int64), counts, len(texts)).astype(np.int64)

    def _encode_even(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without uneven spaces; words are told apart by 64-bit hashes of their bytes."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        begins = data == 32
        begins[(np.cumsum(sizes) - sizes)] = True
        kind = _KIND[data]
        begins[1:] |= ((kind[:-1] == _ALNUM) & (kind[1:] >= _MARK)) | ((kind[:-1] == _MARK) & (kind[1:] == _ALNUM))
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(data)][: len(starts)]
        hashes, first, place = np.unique(Rolling(data).spans(starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        words = [bytes(data[starts[i] : ends[i]]).decode("utf-8", "surrogatepass") for i in first[new]]
        number = np.empty(len(hashes), np.int64)
        number[known] = self.numbers[at[known]]
        number[new] = len(self.counts) + np.arange(len(new))
        if len(new):
            ids, counts = self._encode_words(words)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.numbers = merged[order], np.concatenate([self.numbers, number[new]])[order]
        flat = number[place]
        before, lengths = np.cumsum(self.counts) - self.counts, self.counts[flat]
        words_of = np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0)
        stops = np.r_[0, np.cumsum(lengths)][np.cumsum(words_of)]
        return self.ids[ragged(before[flat], lengths)], np.diff(stops, prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = np.fromiter((_ONE.fullmatch(w) is not None for w in words), bool, len(words))
        sides = [
            self.pieces.ranks.encode_pieces([w.encode("utf-8", "surrogatepass") for w, o in zip(words, one) if o]),
            self.pieces.encode([w for w, o in zip(words, one) if not o]),
        ]
        counts, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        before = 0
        for chosen, (ids, own) in zip((one, ~one), sides):
            counts[chosen], starts[chosen] = own, before + np.cumsum(own) - own
            before += len(ids)
        ids = np.concatenate([ids for ids, _ in sides])
        return ids[ragged(starts, counts)], counts


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> WordEncoder:
    """One encoder for all tasks of a worker, so that words are split and merged once in each."""
    return WordEncoder(path, pattern)
