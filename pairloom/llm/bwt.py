"""Burrows-Wheeler transforms of shards of strings, and their merge.

A shard's strings end in terminators of their own, smaller than every byte. Its transform
holds the symbol before each of its sorted suffixes (rows). The merge never compares
texts or sorts suffixes again: the order of a shard's rows stays as it is, and what is
refined, round by round, is how the rows of the shards interleave.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shard:
    """``bwt``: symbol before each row (0 terminator, else byte + 1); ``string`` and ``offset``: where a row begins."""

    bwt: np.ndarray
    string: np.ndarray
    offset: np.ndarray


#: Symbols compared at once at first: 258 to this power fits 63 bits.
PACKED = 7


def build_shard(strings: list[bytes]) -> Shard:
    """Sorts the suffixes of a few strings, doubling the sorted depth until all differ.

    Terminators are ordered by what follows them, so the strings are sorted as one text.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbols = np.zeros(n + PACKED, np.int64)  # zeros: the end of all
    symbols[:n] = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols[:n] += 2
    symbols[ends - 1] = 1
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key = key * 258 + symbols[j : n + j]
    order, block = _ordered(key)
    block = np.r_[block, -1]
    open_ = order[_shared(block[order])]
    depth = PACKED
    while len(open_):
        open_ = _refine(order, block, open_, block[np.minimum(open_ + depth, n)])
        depth *= 2
    starts, string = np.r_[0, ends[:-1]], np.repeat(np.arange(len(strings)), sizes)
    before = symbols[order - 1] - 1
    before[np.isin(order, starts)] = 0
    return Shard(before.astype(np.int16), string[order], order - starts[string[order]])


def merge_shards(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all shards' rows by their first ``width`` symbols: (order, block).

    Rows count from shard to shard; ``order`` lists them merged, ``block`` is, for each
    row, the merged place of the first row with the same ``width`` symbols. A row that
    meets its terminator earlier has a block of its own.

    Step s of a row is the row of the suffix s symbols further on; one step is the stable
    sort of the transform. If rows are interleaved by depth d, then (own block, block of the row d steps on)
    interleaves them by 2 d. Rows alone in their block are settled and take no part any more.
    """
    sizes = np.array([len(s.bwt) for s in shards])
    firsts = np.cumsum(sizes) - sizes
    step = np.concatenate([np.argsort(s.bwt, kind="stable") + first for s, first in zip(shards, firsts)])
    symbol = np.concatenate([np.sort(s.bwt, kind="stable") for s in shards]).astype(np.int64)
    depth = min(PACKED, width)
    key, row, ended = np.zeros(len(symbol), np.int64), np.arange(len(symbol)), np.zeros(len(symbol), bool)
    onward = {0: row}
    for j in range(depth):
        ended |= symbol[row] == 0
        key = key * 258 + np.where(ended, 0, symbol[row])
        row = step[row]
        onward[j + 1] = row
    order, block = _ordered(key, ended)
    open_ = order[_shared(block[order])]
    steps = {depth: onward[depth]}
    while depth < width and len(open_):
        more = min(depth, width - depth)
        if more < depth:  # the last round looks on as far as is left
            ahead, left, power = onward[more % PACKED if PACKED <= width else 0], more - more % PACKED, PACKED
            while left:
                if left // PACKED & 1:
                    ahead = steps[power][ahead]
                    left -= PACKED
                left //= 2
                power *= 2
        else:
            ahead = steps[depth]
            steps[depth * 2] = ahead[ahead]
        open_ = _refine(order, block, open_, block[ahead[open_]])
        depth += more
    return order, block


def _ordered(key: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows by key, and for each row the place of the first of its block; rows ``alone`` share no block."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(order)]
    if alone is not None:
        new |= alone[order]
    block = np.empty(len(key), np.int64)
    block[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, block


def _refine(order: np.ndarray, block: np.ndarray, rows: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sorts ``rows``, which come block by block, within their blocks by ``second``; returns those that still share one."""
    key = block[rows] * (len(block) + 2) + second + 1
    place = _places(block, rows)
    by = np.argsort(key)
    rows, key = rows[by], key[by]
    order[place] = rows
    new = np.r_[True, key[1:] != key[:-1]]
    block[rows] = place[new][np.cumsum(new) - 1]
    return rows[_shared(block[rows])]


def _shared(blocks: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array have an equal neighbour."""
    same = blocks[1:] == blocks[:-1]
    return np.r_[False, same] | np.r_[same, False] if len(blocks) else np.empty(0, bool)


def _places(block: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Merged places of rows that come block by block: the block's first place and what follows."""
    own = block[rows]
    new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return own + np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))


def repeated_rows(strings: list[bytes], width: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset), sorted, of every ``width``-byte substring that occurs at least twice in the strings."""
    shards, numbers, held, size = [], [], [], 0
    first = 0
    for i, s in enumerate(strings):
        held.append(s)
        size += len(s) + 1
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(build_shard(held))
            numbers.append(shards[-1].string + first)
            first, held, size = i + 1, [], 0
    if not shards:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, block = merge_shards(shards, width)
    rows = order[_shared(block[order])]
    string, offset = np.concatenate(numbers)[rows], np.concatenate([s.offset for s in shards])[rows]
    by = np.lexsort((offset, string))
    return string[by], offset[by]
