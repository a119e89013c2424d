"""Queries on record tables and truth tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.catalog.base import TRUTH_SQL, clean_sql, document_classes, documents, query, table, vectors
from pairloom.functions.text import SEPARATOR, clean, numeric_id
from pairloom.operators import cluster, records, sampling, truth
from pairloom.session import shared_folder
from pairloom.sources import store

COLUMNS = ["site", "lang", "body"]


@query("clean_text", f"SELECT doc_id AS id, {clean_sql('text')} AS body FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("id", clean(F.col("body")).alias("body"))


@query("clean_columns", f"""SELECT doc_id AS id, {clean_sql('source')} AS site, {clean_sql('lang')} AS lang,
  {clean_sql('text')} AS body FROM documents""")
def clean_columns(spark, sf):
    return records.clean_columns(documents(spark, sf).select("id", *COLUMNS), COLUMNS)


@query("record_text", f"""SELECT doc_id AS id, {clean_sql('source')} || '{SEPARATOR}' || {clean_sql('lang')} ||
  '{SEPARATOR}' || {clean_sql('text')} AS text FROM documents""")
def record_text(spark, sf):
    return records.prepare_records(documents(spark, sf).select("id", *COLUMNS), COLUMNS, "a").select("id", "text")


@query("union_sources", f"""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source,
  {clean_sql('text')} AS text FROM documents""")
def union_sources(spark, sf):
    docs = documents(spark, sf).select("id", "body")
    a = records.prepare_records(docs.filter("id % 2 = 0"), ["body"], "a")
    b = records.prepare_records(docs.filter("id % 2 = 1"), ["body"], "b")
    return records.stack_sources(a, b).select("id", "source", "text")


@query("coerce_ids", """SELECT raw, trunc(try_cast(raw AS DOUBLE))::BIGINT AS id,
  trunc(try_cast(raw AS DOUBLE))::BIGINT::VARCHAR AS id_text
  FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey WHEN p_partkey % 2 = 0 THEN p_partkey || '.0'
    ELSE p_partkey::VARCHAR END AS raw FROM part) WHERE try_cast(raw AS DOUBLE) IS NOT NULL""")
def coerce_ids(spark, sf):
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("x"), key)).when(
        F.col("p_partkey") % 2 == 0, F.concat(key, F.lit(".0"))).otherwise(key)
    rows = table(spark, sf, "part").select(raw.alias("raw"))
    kept = records.with_canonical_ids(rows.withColumn("id_text", F.col("raw")), "id_text", numeric=True)
    return kept.withColumn("id", numeric_id("raw")).select("raw", "id", "id_text")


@query("dedupe_last_text", f"""SELECT max(doc_id) AS id, t AS text
  FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents) GROUP BY t""")
def dedupe_last_text(spark, sf):
    side = records.prepare_records(documents(spark, sf).select("id", "body"), ["body"], "b")
    return records.dedupe_last(side.select("id", "text"))


@query("text_lookup", """SELECT o.p_partkey AS id, w.found_id FROM part o
  JOIN (SELECT p_name, max(p_partkey) AS found_id FROM part GROUP BY p_name) w ON w.p_name = o.p_name""")
def text_lookup(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return records.lookup_by_text(parts, parts).select("id", "found_id")


@query("embedded_roundtrip", """SELECT vec_id AS id, (unnest(range(len(embedding))))::INTEGER AS pos,
  round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""")
def embedded_roundtrip(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/pairloom/embedded-{uuid.uuid4().hex}"
    stored = store.write_embedded(vectors(spark, sf).select("id", "v"), path)
    return stored.select("id", F.posexplode("v").alias("pos", "value")).select(
        "id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


# --- truth -------------------------------------------------------------------------


@query("truth_pairs", f"WITH {TRUTH_SQL} SELECT DISTINCT a_id, b_id FROM truth")
def truth_pairs(spark, sf):
    return truth.flatten_multimap(truth.truth_multimap(document_classes(spark, sf).expand()))


@query("truth_grouped", f"""WITH {TRUTH_SQL} SELECT a_id, row_number() OVER (PARTITION BY a_id ORDER BY b_id) - 1 AS position, b_id
  FROM (SELECT DISTINCT a_id, b_id FROM truth)""")
def truth_grouped(spark, sf):
    """The matches of every document in order."""
    return truth.truth_multimap(document_classes(spark, sf).expand())


@query("truth_last", f"WITH {TRUTH_SQL} SELECT a_id, max(b_id) AS b_id FROM truth GROUP BY a_id")
def truth_last(spark, sf):
    return truth.class_last(document_classes(spark, sf))


@query("truth_counts", f"""WITH {TRUTH_SQL} SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT a_id, b_id
  FROM truth)) AS n_pairs, count(DISTINCT a_id) AS n_a, count(DISTINCT b_id) AS n_b FROM truth""")
def truth_counts(spark, sf):
    return truth.class_counts(document_classes(spark, sf))


def _labelled_sides(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ids.filter("id % 2 = 0"), ids.filter("id % 2 = 1")


KNOWN = "a_id IN (SELECT doc_id FROM labels) AND b_id IN (SELECT doc_id FROM labels)"


@query("truth_semi", f"WITH {TRUTH_SQL} SELECT a_id, b_id FROM truth WHERE {KNOWN}")
def truth_semi(spark, sf):
    """The truth among labelled documents."""
    return truth.known_classes(document_classes(spark, sf), *_labelled_sides(spark, sf)).expand()


@query("truth_anti", f"WITH {TRUTH_SQL} SELECT a_id, b_id FROM truth WHERE NOT ({KNOWN})")
def truth_anti(spark, sf):
    """Pairs that name a document without label."""
    return truth.unknown_member_pairs(document_classes(spark, sf), *_labelled_sides(spark, sf))


@query("label_by_class", f"""WITH {TRUTH_SQL}, asked AS (SELECT x.doc_id AS a_id, y.doc_id AS b_id FROM documents x JOIN documents y
  ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0 UNION SELECT a_id, max(b_id) FROM truth GROUP BY a_id)
SELECT a_id, b_id, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.a_id = asked.a_id AND t.b_id = asked.b_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM asked""")
def label_by_class(spark, sf):
    """Neighbours by number, and every document's last match, labelled without expanding a class."""
    classes = document_classes(spark, sf)
    ids = documents(spark, sf).select("id")
    left = ids.filter("id % 2 = 0").select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))
    beside = left.join(ids.select(F.col("id").alias("b_id")), "b_id", "left_semi")
    return truth.label_by_class(beside.select("a_id", "b_id").union(truth.class_last(classes)).distinct(), classes)


# --- samples and sizes ---------------------------------------------------------------


@query("exact_sample", """SELECT doc_id AS id FROM documents ORDER BY md5(doc_id || '#42')
  LIMIT (SELECT (count(*) * 3) // 10 FROM documents)""")
def exact_sample(spark, sf):
    docs = documents(spark, sf).select("id")
    return sampling.exact_sample(docs, docs.count() * 3 // 10, ["id"])


@query("chunk_plan", """SELECT count(*) AS n, (count(*) * 3) // 10 AS sample_size,
  greatest(floor(log10(greatest((count(*) * 3) // 10, 1))), 1)::BIGINT AS chunks FROM documents""")
def chunk_plan(spark, sf):
    """The sample and the number of chunks a run takes for the documents."""
    n = documents(spark, sf).count()
    size = int(n * 3 // 10)
    return spark.range(1).select(
        F.lit(n).cast("long").alias("n"), F.lit(size).cast("long").alias("sample_size"), F.lit(sampling.chunk_count(size)).cast("long").alias("chunks"))


@query("chunk_sizes", "SELECT label AS chunk, count(*) AS n FROM embeddings GROUP BY label")
def chunk_sizes(spark, sf):
    return cluster.chunk_sizes(vectors(spark, sf).withColumnRenamed("label", "chunk"))


@query("cluster_count", "SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def cluster_count(spark, sf):
    return cluster.cluster_count(vectors(spark, sf), "label")
