"""Registration, shared inputs and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import DROPPED_PATTERN, SPACE_PATTERN, clean
from pairloom.operators.knn import knn_join_exact
from pairloom.operators.labels import as_pairs
from pairloom.operators.similarity import similar_stored, store_sets
from pairloom.operators.truth import TruthClasses
from pairloom.session import materialize, scratch, spread

K = 5


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests instead."""

    def register(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors: even ids are side A, odd ids side B ---------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vector_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, sf_dir)
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


def neighbour_pairs(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """The k nearest A rows of every B row as ``(a_id, b_id, sim, rank)``."""
    a, b = vector_sides(spark, sf_dir)
    return as_pairs(knn_join_exact(b, a, k))


def vector_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth for the vectors: the two nearest B rows of every A row. Its size is linear
    in A, and about a third of the candidate pairs are in it."""
    a, b = vector_sides(spark, sf_dir)
    return as_pairs(knn_join_exact(a, b, 2), "b").select("a_id", "b_id")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a label and the fixed score p = (sim + 1) / 2."""
    from pairloom.operators.labels import label_pairs

    pairs = neighbour_pairs(spark, sf_dir).withColumn("p", (F.col("sim") + 1) / 2)
    return label_pairs(pairs.select("a_id", "b_id", "p"), vector_truth(spark, sf_dir))


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored_pairs`` written once, for queries that read it more than once."""
    return materialize(scored_pairs(spark, sf_dir), "scores")


KNN_SQL = f"""
va AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 2 = 0),
vb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 2 = 1),
sims AS (SELECT a.id AS a_id, b.id AS b_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM va a, vb b),
knn AS (SELECT a_id, b_id, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) AS rank FROM sims) WHERE rank <= {K})"""

SCORED_SQL = KNN_SQL + """,
truth AS (SELECT a_id, b_id FROM (
  SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS rank FROM sims) WHERE rank <= 2),
scored AS (SELECT k.a_id, k.b_id, (k.sim + 1) / 2 AS p, CASE WHEN t.a_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label
  FROM knn k LEFT JOIN truth t ON t.a_id = k.a_id AND t.b_id = k.b_id)"""


# --- documents: even ids are side A, odd ids side B -------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), F.col("source").alias("site"), "lang", F.col("text").alias("body"))


def document_classes(spark: SparkSession, sf_dir: str) -> TruthClasses:
    """Near copies between even and odd documents: texts whose word sets, cleaned, overlap by
    at least 0.8 (Jaccard). A class is one cleaned text on one side."""
    cleaned = documents(spark, sf_dir).select("id", clean(F.col("body")).alias("t")).filter("t <> ''")
    return _near_classes(cleaned)


def _near_classes(cleaned: DataFrame) -> TruthClasses:
    words = F.transform(F.array_distinct(F.split("t", " ")), lambda w: F.xxhash64(w))
    side = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    with scratch(cleaned.sparkSession) as keep:
        with scratch(cleaned.sparkSession) as keep_sets:
            keyed = materialize(cleaned.select("id", side.alias("side"), F.md5("t").alias("class"), F.col("t")), "cleaned")
            members = keep(keep_sets(materialize(keyed.select("id", "side", "class"), "members")))
            texts = keyed.groupBy("side", "class").agg(F.first("t").alias("t"))
            sets = keep_sets(store_sets(texts.select((F.col("side") == "b").cast("int").alias("side"), F.col("class").alias("key"), words.alias("tokens"))))
        alike = keep(similar_stored(sets))
    return TruthClasses(members, alike.select(F.col("a_key").alias("a_class"), F.col("b_key").alias("b_class")))


def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each side for every cleaned (site, lang, body): the one of the highest id."""
    docs = documents(spark, sf_dir)
    key = F.md5(F.concat_ws("|", F.col("id") % 2, *[clean(F.col(c)) for c in ("site", "lang", "body")]))
    last = docs.groupBy(key.alias("key")).agg(F.max("id").alias("id"))
    return materialize(docs.join(materialize(last.select("id"), "last"), "id", "left_semi"), "distinct")


def document_truth(distinct: DataFrame) -> DataFrame:
    """The near copies among distinct documents as ``(a_id, b_id)``. A class holds a text once per site and
    language here, however many copies of it there are."""
    classes = _near_classes(distinct.select("id", clean(F.col("body")).alias("t")).filter("t <> ''"))
    return classes.expand()


def clean_sql(column: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace(lower({column}), '{DROPPED_PATTERN}', '', 'g'), "
        f"'{SPACE_PATTERN}', ' ', 'g')), '')"
    )


TRUTH_SQL = f"""
texts AS (SELECT id, t FROM (SELECT doc_id AS id, {clean_sql('text')} AS t FROM documents) WHERE t <> ''),
sets AS (SELECT t, list_distinct(string_split(t, ' ')) AS w FROM (SELECT DISTINCT t FROM texts)),
sides AS (SELECT DISTINCT t, id % 2 AS side FROM texts),
overlap AS (SELECT x.t AS ta, y.t AS tb, len(x.w) AS nx, len(y.w) AS ny, len(list_intersect(x.w, y.w)) AS c
  FROM sets x JOIN sides sx ON sx.t = x.t AND sx.side = 0
  JOIN sets y ON 5 * len(x.w) >= 4 * len(y.w) AND 5 * len(y.w) >= 4 * len(x.w)
  JOIN sides sy ON sy.t = y.t AND sy.side = 1),
truth AS (SELECT a.id AS a_id, b.id AS b_id FROM overlap o JOIN texts a ON a.t = o.ta AND a.id % 2 = 0
  JOIN texts b ON b.t = o.tb AND b.id % 2 = 1 WHERE 5 * c >= 4 * (nx + ny - c))"""
