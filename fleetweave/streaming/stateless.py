"""Streams that need only built-in aggregation state."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATE = "1 minute"


def stream_telemetry(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Poses with a bound on lateness: rows older than the watermark are dropped by the state behind it."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_latest_positions(stream: DataFrame) -> DataFrame:
    """Newest position per robot by event time; update or complete mode.

    A plain aggregate, so a robot that sends a third of the traffic is combined map-side before the shuffle.
    """
    newest = F.max_by(F.struct("x", "y", "ts", "event_id"), F.struct("ts", "event_id"))
    return stream.groupBy("run_id", "robot_id").agg(newest.alias("p")).select("run_id", "robot_id", "p.*")


def stream_merge_counts(receivers: DataFrame) -> DataFrame:
    """Cumulative directed counts from a stream of heard shares; update or complete mode."""
    return receivers.groupBy("run_id", "sender_id", "receiver_id").agg(F.count("*").alias("n_merges"))


def stream_cycles(readings: DataFrame, interval: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Tumbling monitor cycles: the last reading of each interval and the merges in it.

    ``readings(run_id, ts, event_id, mean_sim, merges)``. Append mode: a cycle is final once the watermark passes it.
    """
    windowed = stream_telemetry(readings, late).groupBy("run_id", F.window("ts", interval).alias("w"))
    last = F.max_by("mean_sim", F.struct("ts", "event_id"))
    return (windowed.agg(last.alias("mean_sim"), F.sum("merges").cast("long").alias("merges"))
            .select("run_id", F.col("w.end").alias("ts"), "mean_sim", "merges"))


def stream_share_traffic(shares: DataFrame, interval: str = "8 seconds", slide: str | None = None,
                         late: str = LATE) -> DataFrame:
    """Broadcasts and bytes per robot in tumbling or sliding intervals."""
    window = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return (stream_telemetry(shares, late).groupBy(window.alias("w"), "run_id", "robot_id")
            .agg(F.count("*").alias("broadcasts"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
            .select("run_id", "robot_id", F.col("w.start").alias("start"), "broadcasts", "bytes"))


def stream_encounters(contacts: DataFrame, gap: str = "30 seconds", late: str = LATE) -> DataFrame:
    """Encounters: runs of contacts of a pair, closed once the pair was apart for ``gap``."""
    session = F.session_window("ts", gap)
    return (stream_telemetry(contacts, late).groupBy(session.alias("w"), "run_id", "i", "j")
            .agg(F.count("*").alias("n_contacts"))
            .select("run_id", "i", "j", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_contacts"))


def subscribe(spark: SparkSession, path: str, schema: T.StructType, since: datetime | None = None,
              files_per_trigger: int | None = 10, time: str = "ts", **options) -> DataFrame:
    """Volatile subscription to a folder of parquet files: nothing from before ``since``, a bounded batch at a time.

    Files come by the time they were written, whatever times their rows hold: where rows of later files may be older than
    the watermark allows, None takes all there is as one batch.
    On a Kafka source the same is ``startingOffsets=latest`` with ``maxOffsetsPerTrigger``.
    """
    bound = {} if files_per_trigger is None else {"maxFilesPerTrigger": files_per_trigger}
    stream = (spark.readStream.schema(schema).options(**bound, **options).parquet(path)
              .withColumn(time, F.col(time).cast("timestamp")))
    return stream if since is None else stream.where(F.col(time) >= F.lit(since))
