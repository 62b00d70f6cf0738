"""Choosing frontier targets and judging the goals that were driven to."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.geometry import distance, project_out
from fleetweave.operators import scan
from fleetweave.operators.folds import Rounds
from fleetweave.operators.proximity import near
from fleetweave.params import (BLACKLIST_RADIUS, GOAL_PROJECT, GOAL_TIMEOUT, MAP_REFRESH, MIN_GOAL_DIST,
                               MIN_GOAL_PERIOD, MIN_MOVE, RESEND_RADIUS)

DAY = 24 * scan.HOUR
SEGMENT_ROWS = 512


def drop_blacklisted(targets: DataFrame, blacklist: DataFrame, keys: list[str], ids: list[str],
                     radius: float = BLACKLIST_RADIUS) -> DataFrame:
    """Targets ``tx, ty`` without a blacklisted point ``bx, by`` of the same ``keys`` closer than ``radius``."""
    spots = targets.select(*keys, *[c for c in ids if c not in keys], F.col("tx").alias("lx"), F.col("ty").alias("ly"))
    banned = blacklist.select(*keys, F.col("bx").alias("rx"), F.col("by").alias("ry"))
    hit = near(spots, banned, keys, radius, how="left_semi").select(*ids).distinct()
    return targets.join(hit, ids, "left_anti")


def next_targets(robots: DataFrame, targets: DataFrame, blacklist: DataFrame | None = None,
                 keys: tuple[str, ...] = ("map_id", "seq"), min_dist: float = MIN_GOAL_DIST,
                 project: float = GOAL_PROJECT, radius: float = BLACKLIST_RADIUS) -> DataFrame:
    """Next goal of each robot on its own map.

    The nearest target at least ``min_dist`` away; else the nearest one, its goal projected outward; no row when that
    one gives no heading. ``robots(keys, robot_id, x, y)``, ``targets(keys, cluster_id, tx, ty, n_cells)``. A
    ``blacklist(keys, bx, by)`` bans points of a map for everyone; one with ``robot_id`` and ``ts`` bans them for that
    robot alone, in choices made later than that, and ``robots`` then has the time ``ts`` of each choice.
    """
    keys = list(keys)
    if blacklist is not None and "robot_id" not in blacklist.columns:
        targets = drop_blacklisted(targets, blacklist, keys, [*keys, "cluster_id"], radius)
    away = distance("tx", "ty", "x", "y")
    seen = robots.join(targets, keys).withColumn("_d", away)
    if blacklist is not None and "robot_id" in blacklist.columns:
        ids = [*keys, "robot_id", "cluster_id"]
        spots = seen.select(*ids, F.col("ts").alias("_chosen"), F.col("tx").alias("lx"), F.col("ty").alias("ly"))
        # of equal points the first ban counts
        bans = blacklist.groupBy("robot_id", F.col("bx").alias("rx"), F.col("by").alias("ry")).agg(F.min("ts").alias("_banned"))
        known = near(spots, bans, ["robot_id"], radius, F.col("_banned") < F.col("_chosen"), "left_semi")
        seen = seen.join(known.select(*ids).distinct(), ids, "left_anti")
    # Far targets first, then by distance; a minimum needs no sort and combines map-side.
    order = F.struct((F.col("_d") < min_dist).alias("close"), F.col("_d").alias("d"), F.col("cluster_id"))
    best = seen.groupBy(*keys, "robot_id").agg(
        F.min(F.struct(order.alias("o"), F.struct("x", "y", "tx", "ty", "n_cells").alias("t"))).alias("b"))
    goal = F.when(F.col("b.o.close"), project_out("b.t.x", "b.t.y", "b.t.tx", "b.t.ty", project)).otherwise(
        F.struct(F.col("b.t.tx").alias("x"), F.col("b.t.ty").alias("y")))
    return (best.withColumn("g", goal).where(F.col("g").isNotNull())
            .select(*keys, "robot_id", F.col("b.o.cluster_id").alias("cluster_id"), F.col("g.x").alias("gx"),
                    F.col("g.y").alias("gy"), F.col("b.t.tx").alias("fx"), F.col("b.t.ty").alias("fy"),
                    F.col("b.t.n_cells").alias("n_cells"), F.col("b.o.close").alias("projected")))


def exploration_progress(targets: DataFrame, blacklist: DataFrame, maps: DataFrame,
                         keys: tuple[str, ...] = ("map_id", "seq")) -> DataFrame:
    """Usable targets left on each map; complete when there are none."""
    keys = list(keys)
    left = drop_blacklisted(targets, blacklist, keys, [*keys, "cluster_id"])
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (maps.select(*keys).join(counts, keys, "left")
            .select(*keys, F.coalesce("_n", F.lit(0)).cast("long").alias("n_left"), F.col("_n").isNull().alias("complete")))


def with_dispatched(goal_log: DataFrame, resend: float = RESEND_RADIUS, chunk_sec: float = DAY,
                    rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``dispatched``: false for candidates closer than ``resend`` to the robot's last dispatched goal.

    A step of twice the radius or more from the previous candidate is dispatched whatever came before (triangle
    inequality), so it starts an independent segment; only inside a segment is there a chain to follow.
    """
    order, robot = ["ts", "goal_num"], ["robot_id"]
    chunk = scan.by_time("ts", chunk_sec)
    steps = scan.running(goal_log, robot, order, chunk, prev={"_prev": F.struct("gx", "gy")},
                         total={"_at": F.lit(1).cast("long")})
    jump = distance("gx", "gy", "_prev.gx", "_prev.gy")
    fresh = F.col("_prev").isNull() | (jump >= 2 * resend + 1e-6)
    segments = scan.running(steps.withColumn("_fresh", F.when(fresh, 1).otherwise(0).cast("long")), robot, order, chunk,
                            total={"_segment": "_fresh"})
    keys = ["robot_id", "_segment"]
    rounds = Rounds(segments.select(*keys, "_at", "goal_num", "gx", "gy"), keys, "_at", scan.by_number("_at"), rows)

    def step(acc, c):
        go = acc["last"].isNull() | (distance(c["gx"], c["gy"], acc["last"]["x"], acc["last"]["y"]) >= resend)
        here = F.struct(c["gx"].alias("x"), c["gy"].alias("y"))
        return F.struct(F.when(go, here).otherwise(acc["last"]).alias("last"),
                        F.concat(acc["sent"], F.array(go)).alias("sent"))

    last, sent = None, None
    for candidates in rounds:
        batch = candidates.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("_at", "goal_num", "gx", "gy"))).alias("_c"))
        batch = (batch.withColumn("_last", F.lit(None).cast("struct<x:double,y:double>")) if last is None
                 else batch.join(last, keys, "left"))
        start = F.struct(F.col("_last").alias("last"), F.array().cast("array<boolean>").alias("sent"))
        done = rounds.settle(batch.withColumn("_f", F.aggregate("_c", start, step)))
        # A segment with another round filled this one, so only its last goal is needed there.
        last = done.select(*keys, F.col("_f.last").alias("_last"))
        pairs = F.explode(F.arrays_zip(F.col("_c"), F.col("_f.sent").alias("_sent")))
        flags = (done.select("robot_id", pairs.alias("_p"))
                 .select("robot_id", F.col("_p._c.goal_num").alias("goal_num"), F.col("_p._sent").alias("dispatched")))
        sent = flags if sent is None else sent.unionByName(flags)
    return goal_log.join(sent, ["robot_id", "goal_num"])


def goal_outcomes(goal_log: DataFrame, resend: float = RESEND_RADIUS, min_move: float = MIN_MOVE,
                  timeout: float = GOAL_TIMEOUT, chunk_sec: float = DAY) -> DataFrame:
    """Outcome of every candidate goal and whether its frontier becomes blacklisted.

    re-sent (too close to the last dispatched goal), timed_out, reached, no_motion (succeeded without moving) or failed.
    A log with a ``dispatched`` flag is taken at its word; otherwise the flag is derived.
    """
    log = goal_log if "dispatched" in goal_log.columns else with_dispatched(goal_log, resend, chunk_sec)
    took = (scan.micros("end_ts") - scan.micros("ts")) / 1_000_000
    moved, ok = distance("ex", "ey", "sx", "sy"), F.col("result") == "succeeded"
    outcome = (F.when(~F.col("dispatched"), "resent").when(took > timeout, "timed_out")
               .when(ok & (moved >= min_move), "reached").when(ok, "no_motion").otherwise("failed"))
    return log.withColumn("outcome", outcome).withColumn("blacklisted", F.col("outcome") != "reached")


def blacklist_points(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("blacklisted").select("robot_id", F.col("fx").alias("bx"), F.col("fy").alias("by")).distinct()


def timed_blacklist(outcomes: DataFrame) -> DataFrame:
    """(robot_id, bx, by, ts): points that a robot's goals ruled out, and when; a re-sent goal ends as it is chosen."""
    when = F.when(F.col("outcome") == "resent", F.col("ts")).otherwise(F.col("end_ts"))
    return (outcomes.where("blacklisted").groupBy("robot_id", F.col("fx").alias("bx"), F.col("fy").alias("by"))
            .agg(F.min(when).alias("ts")))


def dispatch_gaps(goal_log: DataFrame, floor_sec: float = MIN_GOAL_PERIOD, chunk_sec: float = DAY) -> DataFrame:
    """Seconds since the robot's previous dispatch, flagged when under the floor; candidates never sent are left out."""
    goal_log = goal_log.where("dispatched") if "dispatched" in goal_log.columns else goal_log
    seen = scan.running(goal_log, ["robot_id"], ["ts", "goal_num"], scan.by_time("ts", chunk_sec), prev={"_was": "ts"})
    gap = (scan.micros("ts") - scan.micros("_was")) / 1_000_000
    return seen.withColumn("gap_sec", gap).withColumn(
        "too_soon", F.coalesce(F.col("gap_sec") < floor_sec, F.lit(False))).drop("_was")


WAITED = ("reached", "no_motion", "failed")


def stale_maps(goal_log: DataFrame, maps: DataFrame, refresh_sec: float = MAP_REFRESH,
               chunk_sec: float = DAY) -> DataFrame:
    """Goals after which no newer map arrived in time.

    ``maps(robot_id, ts)``. A map newer than the dispatch counts, also when it arrived while driving. Of a log with
    outcomes only goals that end by themselves are judged: re-sent and timed-out ones wait for no map.
    """
    goal_log = goal_log.where(F.col("outcome").isin(*WAITED)) if "outcome" in goal_log.columns else goal_log
    goals = goal_log.select("robot_id", "ts", F.lit(0).alias("kind"), F.col("goal_num").alias("tie"), "end_ts")
    seen = maps.select("robot_id", "ts", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"))
    clock = goals.unionByName(seen, allowMissingColumns=True).withColumn("_back", -scan.micros("ts"))
    ahead = scan.running(clock, ["robot_id"], ["_back", "kind", "tie"], -scan.by_time("ts", chunk_sec),
                         last={"next_map": F.when(F.col("kind") == 1, F.col("ts"))})
    wait = (scan.micros("next_map") - scan.micros("end_ts")) / 1_000_000
    return (ahead.where("kind = 0")
            .select("robot_id", F.col("tie").alias("goal_num"), "ts", "end_ts", "next_map",
                    F.coalesce(wait > refresh_sec, F.lit(True)).alias("stale")))
