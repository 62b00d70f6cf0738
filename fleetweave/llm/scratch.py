"""Tables written once into the folder that ``spark.checkpoint.dir`` names, so lost executors lose nothing."""
from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetweave.session import shared_dir

_written: list = []


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/fleetweave-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; removed when the driver's Python ends."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame) -> int:
    """Number of parts that exchanged rows are dealt to; follows the session, and so the size of the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm, context = spark._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder belongs to the cluster
            return
