"""Session settings and lineage cuts."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Joins carry no size hints: adaptive execution broadcasts a side only
# after measuring it, and splits skewed partitions of the joins that stay shuffled.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What one task takes at most, unless the session has chosen for itself. Rows of a few numbers unfold to twenty times their
# compressed size in sorts and hash maps, so the usual 64 and 128 MB would be gigabytes of one task's memory.
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    chosen = spark._jsparkSession.sessionState().conf().getAllConfs()
    for name, value in TASK_SIZES.items():
        if not chosen.contains(name):
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary folder in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


@contextmanager
def _cleared(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it ends: nobody reads them once its result is stored.

    Otherwise they stay until the driver happens to collect its garbage, and the steps of a long job add up.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a reliable checkpoint, so lost executors never replay the whole loop."""
    shared_dir(df.sparkSession)
    with _cleared(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage`` for large tables: Parquet in the shared folder takes a fraction of a checkpoint's disk."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _cleared(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that ``written`` made of ``df``; nothing that is still to run may read it."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
