"""A key holding a third of all rows must not become one task."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import features, knn, records

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def shuffled_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(column, n=60_000):
    return F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % n)


def test_hot_record_is_split(spark, shuffled_joins):
    ids = spark.range(60_000)
    pairs = ids.select(hot("id").alias("a_id"), F.col("id").alias("b_id"), F.md5(F.col("id").cast("string")).alias("pad"))
    vectors = ids.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    joined = features.attach_records(pairs.repartition(16), vectors.repartition(16), vectors.repartition(16))
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 60_000


def test_hot_text_is_split(spark, shuffled_joins):
    rows = spark.range(60_000).select("id", hot("id").cast("string").alias("text"), F.md5(F.col("id").cast("string")).alias("pad")).repartition(16)
    looked_up = records.lookup_by_text(rows, rows)
    assert "skew=true" in final_plan(looked_up)
    assert looked_up.count() == 60_000


def test_hot_cell_becomes_many_blocks(spark):
    index = spark.range(3000).select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double") * 1e-9).alias("v"))
    cells = knn.build_cells(index)
    assert cells.leaves.agg(F.max("n")).first()[0] > 900
    original = knn._top

    def watch(queries, block, k, skip):
        assert len(block) <= 400 and len(queries) <= 400
        return original(queries, block, k, skip)

    knn._top = watch
    try:
        got = knn.knn_join_cells(index, cells, 2, probes=(9, 999), block_rows=200).collect()
    finally:
        knn._top = original
    assert len(got) == 6000
    assert {r.index_id for r in got if r["rank"] == 1} == {0}
