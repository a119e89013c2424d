import random
import re

import duckdb
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import strings
from pairloom.functions.strings import jaro_winkler, jaro_winkler_value
from pairloom.functions.text import canonical_id, clean, record_text

TRICKY = [
    "  Hello,   World! ", "Café-Crème №5", "tab\tnew\nline\x0bvt", "nbsp here em", "under_score", "...", "", None,
    "ÀÉÎ 123 ４５", "emoji 😀 ok", "combining é", "a\x85b\x1cc", "Zürich—Köln", "ß ẞ",
]


def by_python(text):
    if text is None:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()


def test_clean_equals_python_rules(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean(F.col("t")).alias("c")).collect()}
    assert got == {i: by_python(t) for i, t in enumerate(TRICKY)}


def test_record_text_keeps_every_separator(spark):
    df = spark.createDataFrame([("x", None, "z"), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(record_text(["a", "b", "c"])).collect()]
    assert got == ["x [SEP]  [SEP] z", " [SEP]  [SEP] "]


def test_canonical_ids(spark):
    raw = ["12", "12.0", " 12", "abc", "", None, "12.9", "1e3", "NaN", "inf"]
    df = spark.createDataFrame([(r,) for r in raw], "id string")
    got = [r[0] for r in df.select(canonical_id("id", numeric=True)).collect()]
    assert got[:8] == ["12", "12", "12", None, None, None, "12", "1000"]
    assert got[9] is None
    assert [r[0] for r in df.limit(3).select(canonical_id("id")).collect()] == ["12", "12.0", "12"]


def test_jaro_winkler_equals_duckdb_on_ascii():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(800)] + [("", ""), ("a", ""), ("same", "same"), ("martha", "marhta")]
    con = duckdb.connect()
    for a, b in pairs:
        assert jaro_winkler_value(a, b) == pytest.approx(jaro_winkler_value(b, a), abs=1e-12)
    con.execute("CREATE TABLE t (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    for a, b, wanted in con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM t").fetchall():
        assert jaro_winkler_value(a, b) == pytest.approx(wanted, abs=1e-9), (a, b)


def test_jaro_winkler_counts_code_points_and_nulls(spark):
    df = spark.createDataFrame([("é", "è"), ("é", "é"), (None, "x"), ("dwayne", "duane")], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.0, 0.84])


def test_long_strings_are_matched_by_whole_arrays(monkeypatch):
    """Each character of a long text was looked up in Python; both ways must agree to the last bit."""
    draw = random.Random(8)
    alphabets = ["ab", "abc ", "abcdefghij klmno", "a\u00e9\U0001f600b", "\u00e9\u6f22\u5b57ab "]
    for _ in range(600):
        letters = draw.choice(alphabets)
        a = "".join(draw.choice(letters) for _ in range(draw.randint(1, 60)))
        b = draw.choice([a[::-1], a[len(a) // 2:] + a[: len(a) // 3], a * 3, "".join(draw.choice(letters) for _ in range(draw.randint(1, 60)))])
        assert strings._matched(strings.Places.of(a), strings.Places.of(b)) == strings._matched_short(a, b), (a, b)
    monkeypatch.setattr(strings, "_matched_short", None)
    text = "some words of a longer text " * 40
    assert 0.9 < jaro_winkler_value(text, text[:500] + "other" + text[500:]) < 1
