"""Documents that hold every awkward case, and plain Python versions of what several tests count."""

import re
import zlib

LONG = "lorem ipsum dolor sit amet " * 4000
PROSE = " ".join(f"word{i % 37}x{i}" for i in range(120))
NEAR = PROSE.replace("word3x3 ", "changed ")

ROWS = [
    (1, PROSE, "en", "a", 0),
    (2, PROSE, "en", "a", 0),
    (2, PROSE, "en", "a", 0),
    (3, NEAR, None, None, None),
    (4, "", "en", "b", 0),
    (5, None, None, "b", None),
    (None, "one two three", "en", "c", 1),
    (6, " \t\n ", "fr", "c", 2),
    (7, "one two three", "en", "a", 3),
    (8, LONG, "en", "a", 4),
    (9, "É漢😀 naïve\n\nÉ漢😀 naïve\r\n\x0b x", "fr", "a", 5),
    (10, PROSE.upper() + " tail", "en", "a", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """Columns named like those the operators make for themselves."""
    from pyspark.sql import functions as F

    names = ["uid", "body", "score", "node", "part", "kept", "k1", "k2", "host_key", "text_key", "atom", "base", "held", "c0", "words"]
    return docs.withColumns({n: F.lit("x") for n in names})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def given(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet")
