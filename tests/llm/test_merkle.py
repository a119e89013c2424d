import hashlib
import itertools
import random
import zlib

import duckdb
import shared
from pairloom.llm import merkle
from pairloom.llm.manifest_sql import FIELDS, MANIFEST_SQL
from pairloom.llm.queries import op11_merkle
from pyspark.sql import functions as F


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n = row
    written = [None if v is None else str(v) for v in (doc_id, source, lang, n, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in written))


def tree(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """(place, siblings) of a leaf on each level."""
    for level in levels[:-1]:
        start = at // 16 * 16
        run = level[start : start + 16]
        yield at - start, run[: at - start] + run[at - start + 1 :]
        at //= 16


def plain(rows):
    low = lambda r: (r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
    changed = lambda r: r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of(low(r)) if changed(r) else leaf_of(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    for i, name in enumerate(names):
        for j, (_, _, leaf, today, doc_id) in enumerate(groups[name]):
            way = [*path(trees[name], j), *path(top, i)]
            for place, others in way:
                today = h("".join([*others[:place], today, *others[place:]]))
            proof = h("".join(itertools.chain.from_iterable(others for _, others in way)))
            yield doc_id, leaf, trees[name][-1][0], top[-1][0], proof, today, today == top[-1][0]


def manifest(docs, **settings):
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    text = F.when(changed, F.translate("text", merkle.LETTERS, merkle.LETTERS.lower())).otherwise(F.col("text"))
    return merkle.merkle_manifest(docs, FIELDS, tampered={"text": text}, **settings)


def check(docs, rows):
    got = manifest(docs).collect()
    # Rows alike in every field are interchangeable, so which of them has which proof is open.
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    return got


def test_awkward_rows(spark):
    rows = [*shared.ROWS, (2**60 + 1, "Big ID", "en", None, 1), (-5, "Negative", "en", "é", 1), (11, "x", "", "", 0)]
    got = check(shared.clashing(shared.documents(spark, rows)), rows)
    assert {r.verified for r in got} == {True, False}
    assert manifest(shared.documents(spark, [])).count() == 0
    check(shared.documents(spark, [(1, "A lone leaf", "en", "a", 0)]), [(1, "A lone leaf", "en", "a", 0)])


def test_all_shapes_of_trees(spark):
    rng = random.Random(3)
    sizes = [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4097, *([1] * 20)]
    rows = [(rng.randrange(10**12), f"Text {g} {i}", "en", f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    check(shared.documents(spark, rows).repartition(7), rows)


def test_many_groups(spark):
    rows = [(i, f"T{i}", "en", f"host{i // 2}", 0) for i in range(700)]
    check(shared.documents(spark, rows), rows)


def test_given_documents_equal_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    con.execute(MANIFEST_SQL)
    got = op11_merkle(spark, folder)
    assert got.columns == [c[0] for c in con.description]
    found, wanted = sorted(map(tuple, got.collect()), key=repr), sorted(con.fetchall(), key=repr)
    assert found == wanted and len(found) == 1000
    rows = [tuple(r) for r in shared.given(spark, folder).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found == sorted(plain(rows), key=repr)


def test_a_way_proves_its_leaf_and_no_other(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", 0) for i in range(600)]
    got = manifest(shared.documents(spark, rows), with_proofs=True).collect()
    for a, b in zip(got, got[1:]):
        assert merkle.fold(a.leaf, a.way) == a.root
        assert merkle.fold(b.leaf, a.way) != a.root


def test_a_block_holds_a_bounded_heap():
    made = merkle.climb([h(str(i)) for i in range(256)], 2)
    assert [len(x) for x in made] == [256, 16, 1]
    ways = dict(merkle.descend(made, ""))
    assert sorted(ways) == list(range(256))
    assert all(merkle.fold(made[0][i], way) == made[2][0] for i, way in ways.items())
