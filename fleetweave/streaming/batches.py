"""Micro-batches that run a batch plan, and table sinks that survive replays.

Every epoch writes its own folder, so a replayed epoch overwrites itself and nothing else.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.operators import convergence, frontiers, merging, motion, proximity, scan
from fleetweave.params import MIN_CLUSTER, Params
from fleetweave.session import shared_dir
from fleetweave.sinks.rejects import with_rejects

_P = Params()
FOLD = 16  # epochs whose changes are read one by one


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def epoch_writer(path: str):
    """foreachBatch function appending each epoch as its own partition folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest row per key from folders written in update mode."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, "epoch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def run_now(stream: DataFrame, write, mode: str, checkpoint: str) -> None:
    """Work through all available input with ``write`` as foreachBatch, then stop."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def publish_convergence(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Publish (run_id, ts, mean_sim) as single precision to an append-only table; returns the running query."""
    values = stream.select("run_id", "ts", F.col("mean_sim").cast("float").alias("mean_sim"))
    return (values.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


class Log:
    """Rows per key over epochs: what the newest epoch wrote of a key replaces all its earlier rows.

    Each epoch writes the rows of the keys it changed, and every ``FOLD`` epochs one table of all, so what is written follows
    the batch. Epoch n reads what was written up to n - 1, so replays are harmless. Folding costs each row one more write in
    ``FOLD`` epochs, and reading opens ``FOLD`` small tables at most. A key may hold any number of rows. With ``idle``, keys
    expire once nothing with the same ``by`` columns (all key columns by default) has changed for that many epochs: counted by
    arrival, so a wrong clock lets nobody expire. Keys that are null are not kept.
    """

    def __init__(self, path: str, keys: list[str], idle: int | None = None, by: list[str] | None = None):
        self.path, self.keys, self.idle, self.by = path, keys, idle, by or keys

    def _parts(self, epoch: int) -> list[str]:
        """Tables that hold the state after an epoch."""
        base = epoch - epoch % FOLD
        return [f"{self.path}/all/epoch={base}"] * (base > 0) + [f"{self.path}/new/epoch={k}" for k in range(base + (base > 0), epoch + 1)]

    def _current(self, spark: SparkSession, parts: list[str], epoch: int, schema) -> DataFrame:
        every = spark.read.schema(T.StructType([*schema, T.StructField("_epoch", T.LongType())])).parquet(*parts)
        changed = every.groupBy(*self.keys).agg(F.max("_epoch").alias("_epoch"))
        if self.idle is not None:
            heard = changed.groupBy(*self.by).agg(F.max("_epoch").alias("_heard")).where(F.col("_heard") >= epoch - self.idle)
            changed = changed.join(heard, self.by, "left_semi")
        return every.join(changed, [*self.keys, "_epoch"], "left_semi")

    def load(self, spark: SparkSession, epoch: int, schema) -> DataFrame:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if epoch == 0:
            return spark.createDataFrame([], schema)
        return self._current(spark, self._parts(epoch - 1), epoch, schema).drop("_epoch").select(*schema.names)

    def save(self, changed: DataFrame, epoch: int) -> None:
        spark, fresh = changed.sparkSession, f"{self.path}/new/epoch={epoch}"
        changed.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(fresh)
        if epoch and epoch % FOLD == 0:
            parts = [*self._parts(epoch - 1), fresh]
            self._current(spark, parts, epoch, changed.schema).write.mode("overwrite").parquet(f"{self.path}/all/epoch={epoch}")
            # the tables before the last fold are no longer read, not even by a replay of this epoch
            for old in range(max(0, epoch - 2 * FOLD), epoch - FOLD):
                _remove(spark, f"{self.path}/new/epoch={old}")
                _remove(spark, f"{self.path}/all/epoch={old}")


def receiver_batches(state: str, out: str, comm_range: float = 3.0, bucket_sec: float = 8.0,
                     chunk_sec: float = scan.HOUR, late_sec: float = 60.0, idle: int | None = None):
    """foreachBatch function expanding shares to the robots in range, with positions carried between batches.

    Batches hold ``(run_id, robot_id, ts, kind, event_id, x, y)``, kind 0 poses and kind 1 shares by that robot. Of each
    robot the rows of the last ``late_sec`` by its own clock and the newest one before are carried, so shares up to that
    late still see the position of their time, and a wrong clock trims the poses of its own robot alone. Only robots with
    poses in a batch are written again, and only runs of the batch are read; ``idle`` is the number of epochs without a pose
    after which a run's poses expire. Shares older than the poses kept of their sender go to ``state``-rejects.
    """
    columns, robot = ["run_id", "robot_id", "ts", "event_id", "x", "y"], ["run_id", "robot_id"]
    carried = Log(state, robot, idle, ["run_id"])

    def expand(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        fresh = batch.where("kind = 0").select(*columns)
        before = carried.load(batch.sparkSession, epoch, fresh.schema)
        before = before.join(batch.select("run_id").distinct(), "run_id", "left_semi").select(*columns)
        poses = fresh.unionByName(before)
        shares = batch.where("kind = 1").select("run_id", F.col("robot_id").alias("sender_id"), "ts",
                                                F.col("event_id").alias("msg_id"))
        heard = proximity.share_receivers(shares, poses, comm_range, bucket_sec, chunk_sec)
        heard.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        kept = before.groupBy("run_id", F.col("robot_id").alias("sender_id")).agg(F.min("ts").alias("_kept"))
        late = shares.join(kept, ["run_id", "sender_id"]).where("ts < _kept").drop("_kept")
        late.withColumn("error", F.lit("no pose of the sender is kept from that time")).write.mode("overwrite").parquet(
            f"{state}-rejects/epoch={epoch}")
        poses = poses.join(fresh.select(*robot).distinct(), robot, "left_semi")
        edge = poses.groupBy(*robot).agg((F.max("ts") - F.make_dt_interval(secs=F.lit(late_sec))).alias("_edge"))
        marked = poses.join(edge, robot)
        last = marked.where("ts < _edge").groupBy(*robot).agg(_newest_row(columns[2:]))
        recent = marked.where("ts >= _edge").select(*columns)
        carried.save(recent.unionByName(last.select(*robot, "p.*")), epoch)
        batch.unpersist()

    return expand


def _newest_row(columns: list[str]):
    return F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("p")


def stuck_batches(state: str, out: str, window_sec: float = _P.stuck_window, eps_m: float = _P.stuck_epsilon,
                  chunk_sec: float = scan.HOUR, idle: int | None = None):
    """foreachBatch function judging ticks; samples of the last window, the newest pose and clear are carried per robot.

    Batches hold ``(run_id, robot_id, ts, kind, event_id, x, y, speed)``, kind as in ``motion``: pose, sample, tick,
    clear. A long backlog in one batch is still cut into time chunks, whatever robot it belongs to. Only robots of the batch
    are read on and written again; ``idle`` is the number of epochs without a row after which a run expires. Ticks that are
    older than a row carried of their robot can't be judged any more and go to ``state``-rejects.
    """
    rest = ["ts", "kind", "event_id", "x", "y", "speed"]
    columns = [*motion.ROBOT, *rest]
    carried = Log(state, motion.ROBOT, idle, ["run_id"])

    def judge(batch: DataFrame, epoch: int) -> None:
        batch = batch.select(*columns).persist()
        before = carried.load(batch.sparkSession, epoch, batch.schema)
        before = before.join(batch.select(*motion.ROBOT).distinct(), motion.ROBOT, "left_semi").select(*columns)
        known = before.groupBy(*motion.ROBOT).agg(F.max("ts").alias("_known"))
        ticks = batch.where(F.col("kind") == motion.TICK).join(known, motion.ROBOT, "left")
        late = F.coalesce(F.col("ts") < F.col("_known"), F.lit(False))
        ticks, rejects = with_rejects(ticks, {"before a row judged already": late})
        rejects.drop("_known").write.mode("overwrite").parquet(f"{state}-rejects/epoch={epoch}")
        clock = batch.where(F.col("kind") != motion.TICK).unionByName(before)
        of = lambda kind: clock.where(F.col("kind") == kind)
        verdicts = motion.stuck(of(motion.SAMPLE), ticks.select(*columns), of(motion.ODOM), window_sec, eps_m,
                                of(motion.CLEAR), chunk_sec)
        verdicts.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        marks = clock.groupBy(*motion.ROBOT).agg(
            F.max(F.when(F.col("kind") == motion.SAMPLE, F.col("ts"))).alias("_sampled"),
            F.max(F.when(F.col("kind") == motion.CLEAR, F.col("ts"))).alias("_cleared"))
        kept = (of(motion.SAMPLE).join(marks, motion.ROBOT)
                .where(F.col("ts") >= F.col("_sampled") - F.make_dt_interval(secs=F.lit(window_sec)))
                .where(F.col("_cleared").isNull() | (F.col("ts") > F.col("_cleared"))).select(*columns))
        single = clock.where(F.col("kind").isin(motion.ODOM, motion.CLEAR))
        single = single.groupBy(*motion.ROBOT, F.col("kind").alias("_kind")).agg(_newest_row(rest)).select(*motion.ROBOT, "p.*")
        carried.save(kept.unionByName(single), epoch)
        batch.unpersist()

    return judge


def merge_batches(state: str, out: str, agents: DataFrame, self_w: float = _P.self_weight,
                  recv_w: float = _P.recv_weight):
    """foreachBatch function folding arriving vectors into beliefs, which are carried between batches.

    Batches hold ``(receiver_id, seq, r)``; writes (agent_id, z, n_folded) of the agents that merged, n_folded in total, and
    to ``state``-rejects the events that ``merging.checked_merges`` finds fault with. A batch reads the beliefs of its own
    receivers and writes those that changed; ``agents`` are the beliefs before the stream.
    """
    carried = Log(state, ["agent_id"])
    start = agents.select("agent_id", F.col("z").cast("array<double>").alias("z"), F.lit(0).cast("long").alias("_n"))

    def fold(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        asked = batch.select(F.col("receiver_id").alias("agent_id")).distinct()
        held = carried.load(batch.sparkSession, epoch, start.schema).join(asked, "agent_id", "left_semi")
        first = start.join(asked, "agent_id", "left_semi").join(held, "agent_id", "left_anti")
        beliefs = held.unionByName(first)
        rejects = merging.checked_merges(beliefs, batch).where("error is not null")
        rejects.write.mode("overwrite").parquet(f"{state}-rejects/epoch={epoch}")
        merged = merging.merge_embeddings(beliefs, batch, self_w, recv_w).where("n_folded > 0")
        merged = merged.withColumn("_n", F.col("n_folded") + F.col("_n")).persist()
        merged.select("agent_id", "z", F.col("_n").alias("n_folded")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        carried.save(merged.select("agent_id", "z", "_n"), epoch)
        merged.unpersist()
        batch.unpersist()

    return fold


def convergence_batches(state: str, out: str, params: Params = _P, chunk_sec: float = scan.HOUR):
    """foreachBatch function judging cycles as the batch operator does, with one carried row per run.

    Batches hold ``(run_id, ts, mean_sim, merges)``, merges of the cycle itself. Within a batch rows may come in any order,
    and a long backlog of one run is cut into time chunks. Rows that are not after all rows judged before of their run
    can't be judged any more: they go to ``out``/rejects with an error text, epoch by epoch. Carried rows are kept per
    epoch for the runs of that epoch alone, so what is written follows the batch; every ``FOLD`` epochs they are folded.
    """
    carried, run = Log(state, ["run_id"]), ["run_id"]
    kept = "run_id string, last timestamp, base double, sim double, merged long, calm long, done boolean"

    def judge(batch: DataFrame, epoch: int) -> None:
        batch = batch.select("run_id", "ts", "mean_sim", "merges").persist()
        before = carried.load(batch.sparkSession, epoch, kept)
        entry = before.join(batch.select("run_id").distinct(), run, "left_semi")
        known = batch.join(entry.select("run_id", "last"), run, "left")
        late = F.coalesce(F.col("ts") <= F.col("last"), F.lit(False))
        good, bad = with_rejects(known, {"no time": F.col("ts").isNull(), "not after the last reading judged": late})
        bad.drop("last").write.mode("overwrite").parquet(f"{out}/rejects/epoch={epoch}")
        chunk = scan.by_time("ts", chunk_sec)
        summed = scan.running(good.drop("last"), run, ["ts"], chunk, total={"_heard": F.col("merges").cast("long")})
        summed = summed.join(entry.select("run_id", "merged"), run, "left").withColumn(
            "merges", F.coalesce("merged", F.lit(0).cast("long")) + F.coalesce("_heard", F.lit(0).cast("long"))).drop("merged", "_heard")
        verdicts = convergence.judged(summed, "ts", chunk, params.min_rise, params.stability_eps, params.stable_cycles, entry)
        verdicts = verdicts.drop("has_prev").persist()
        verdicts.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")
        newest = F.max_by(F.struct("baseline", "mean_sim", "merges", "stable", "converged"), "ts").alias("_r")
        latest = verdicts.groupBy("run_id").agg(F.max("ts").alias("last"), newest).select(
            "run_id", "last", F.col("_r.baseline").alias("base"), F.col("_r.mean_sim").alias("sim"), F.col("_r.merges").alias("merged"),
            F.col("_r.stable").alias("calm"), F.col("_r.converged").alias("done"))
        carried.save(latest, epoch)
        verdicts.unpersist()
        batch.unpersist()

    return judge


def frontier_batches(out: str, min_cells: int = MIN_CLUSTER):
    """foreachBatch function writing the frontier targets of each batch of new maps."""
    def detect(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        labelled = frontiers.frontier_clusters(frontiers.grid_frontier(batch))
        frontiers.cluster_centroids(labelled, batch, min_cells).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        batch.unpersist()

    return detect
