import collections
import itertools
import random
import zlib

import shared
from pairloom.llm import sharding


def best_capacity(sizes, shards):
    """The least possible largest shard over all ways to cut."""
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cuts, len(sizes)]
        largest = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
        best = largest if best is None else min(best, largest)
    return best


def test_cuts_are_minimax():
    rng = random.Random(4)
    for _ in range(120):
        sizes = [rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(0, 9))]
        shards = rng.randint(1, 4)
        edges = [0, *sharding.cuts_for(sizes, shards), len(sizes)]
        assert edges == sorted(edges) and len(edges) == shards + 1
        assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) == best_capacity(sizes, shards)


def check(docs, rows, **settings):
    got = sharding.shard_documents(docs, **settings).collect()
    plain = lambda r: (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(map(plain, rows), key=repr)
    slots, shards = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values()) and set(slots) <= set(range(16))
    return got


def test_awkward_rows(spark):
    check(shared.clashing(shared.documents(spark)), shared.ROWS)
    check(shared.clashing(shared.documents(spark)), shared.ROWS, cells=2, digits=1)
    assert sharding.shard_documents(shared.documents(spark, [])).count() == 0


def test_shards_of_the_given_documents_are_even(spark, small):
    docs = shared.given(spark, "/root/testdata/sf0.01")
    got = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    sizes, groups = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
        groups[r.text_crc32] += r.size
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(groups.values())


def test_a_hot_text_fills_its_shard(spark):
    rows = [(i, "hot " * 50, "en", "s", 0) for i in range(300)] + [(1000 + i, f"text {i} " * 8, "en", "s", 0) for i in range(200)]
    got = check(shared.documents(spark, rows), rows)
    assert len({r.shard for r in got if r.doc_id < 1000}) == 1 and len({r.shard for r in got}) > 10


def test_no_python_in_the_plan(spark, small):
    plan = sharding.shard_documents(shared.given(spark, small))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
