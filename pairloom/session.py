"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "pairloom", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "--add-modules=jdk.incubator.vector")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster such
    a folder would be visible to one machine and lost with it.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder
    folder = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def spread(scan: DataFrame) -> DataFrame:
    """A freshly read table, over at least as many partitions as there are cores.

    Large tables come in many splits and pass unchanged; a small file with a single
    row group would otherwise keep one core busy and the others idle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan restarts from Parquet, so lineage stays short, a lost executor costs
    one task and the optimizer sees real sizes. A grouped table that is joined on its
    group key goes through here too: joined directly it would keep the partitioning
    of the grouping, and adaptive execution only splits a hot key where both sides
    of the join have a shuffle of their own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if _open_blocks:
        _open_blocks[-1].add(path)
    stored = spark.read.schema(_order_last(df, partition_by)).parquet(path)
    stored.stored_at = path
    return stored


_open_blocks: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops the tables stored inside the block at its end, but for those given to ``keep``.

    Only what is kept may be read after the block. A kept table belongs to the block around, if any.
    """
    made, kept = set(), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    _open_blocks.append(made)
    try:
        yield keep
    finally:
        _open_blocks.remove(made)
        if _open_blocks:
            _open_blocks[-1].update(kept)
        for path in made - kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Drops the shuffle files of jobs that have ended. Spark does so when the driver's heap is collected, which may come late."""
    spark._jvm.System.gc()


def _order_last(df: DataFrame, partition_by: str | None):
    if partition_by is None:
        return df.schema
    kept = [c for c in df.columns if c != partition_by]
    return df.select(*kept, partition_by).schema
