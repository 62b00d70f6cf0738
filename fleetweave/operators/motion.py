"""Motion analytics: stuck robots, escapes, behaviour and frozen formations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.functions.geometry import distance
from fleetweave.operators import scan
from fleetweave.operators.proximity import contacts_at
from fleetweave.params import Params
from fleetweave.session import cut_lineage

ROBOT = ["run_id", "robot_id"]
_P = Params()
# Order of events at equal times.
ODOM, SAMPLE, TICK, CLEAR = 0, 1, 2, 3


def _clock(df: DataFrame, kind: int, tie: str = "event_id", **columns) -> DataFrame:
    return df.select(*ROBOT, "ts", F.lit(kind).alias("kind"), F.col(tie).alias("tie"),
                     *[c.alias(n) for n, c in columns.items()])


def stuck(samples: DataFrame, ticks: DataFrame, odom: DataFrame, window_sec: float = _P.stuck_window,
          eps_m: float = _P.stuck_epsilon, clears: DataFrame | None = None,
          chunk_sec: float = scan.HOUR) -> DataFrame:
    """Judge every tick: driven throughout a whole window, yet hardly moved.

    ``samples(run_id, robot_id, ts, event_id, x, y, speed)`` are the recorded commands, ``odom`` the poses,
    ``ticks(run_id, robot_id, ts, event_id)`` the moments of judgement and ``clears`` the moments at which the sample
    history was emptied. A tick looks at the samples of the window that ends at the newest sample. Work follows the rows,
    however many samples a window holds; event ids are numbers.
    """
    point = F.struct("x", "y")
    taken = _clock(samples, SAMPLE, pos=point, speed=F.col("speed"))
    parts = [taken, _clock(odom, ODOM, pos=point), _clock(ticks, TICK)]
    if clears is not None:
        parts.append(_clock(clears, CLEAR))
    clock = parts[0]
    for part in parts[1:]:
        clock = clock.unionByName(part, allowMissingColumns=True)
    # The samples that count at a tick are those from one moment on up to the newest: their number and what they were driven at
    # follow from running counts at both ends, so nothing is looked at once per row of a window.
    order, sample = ["ts", "kind", "tie"], F.col("kind") == SAMPLE
    counts = {"_n": sample, "_known": sample & F.col("speed").isNotNull(), "_idle": sample & (F.col("speed") <= 0)}
    known = scan.running(clock, ROBOT, order, scan.by_time("ts", chunk_sec),
                         total={name: F.coalesce(test, F.lit(False)).cast("long") for name, test in counts.items()},
                         last={"here": F.when(F.col("kind") == ODOM, F.col("pos")), "newest": F.when(sample, F.col("ts")),
                               "emptied": F.when(F.col("kind") == CLEAR, F.col("ts"))})
    since = F.greatest(scan.micros("newest") - int(window_sec * 1_000_000), scan.micros("emptied") + 1)
    at = F.when(sample, scan.micros("ts")).otherwise(F.coalesce(since, scan.micros("ts")))
    # Backwards, the last sample at or after a tick's moment is the oldest that counts.
    back = known.where(F.col("kind").isin(SAMPLE, TICK)).select(
        *ROBOT, *order, "pos", "speed", "here", "newest", "emptied", *counts, (-at).alias("_back"), (-F.col("tie")).alias("_tie"))
    before = [(F.col(name) - F.coalesce(test, F.lit(False)).cast("long")).alias(name) for name, test in counts.items()]
    met = scan.running(cut_lineage(back), ROBOT, ["_back", "kind", "_tie"], -scan.by_time(F.timestamp_micros(-F.col("_back")), chunk_sec),
                       last={"oldest": F.when(sample, F.struct("ts", "pos", *before))})

    inside = {name: F.col(name) - F.col(f"oldest.{name}") for name in counts}
    span = (scan.micros("ts") - scan.micros("oldest.ts")) / 1_000_000
    moved = distance("here.x", "here.y", "oldest.pos.x", "oldest.pos.y")
    fresh = F.col("newest").isNotNull() & (F.col("emptied").isNull() | (F.col("emptied") < F.col("newest")))
    enough = fresh & (inside["_n"] >= 2) & (span >= window_sec)
    verdict = enough & (inside["_known"] > 0) & (inside["_idle"] == 0) & (moved < eps_m)
    return (met.where(F.col("kind") == TICK)
            .select(*ROBOT, "ts", F.col("tie").alias("event_id"), F.coalesce(verdict, F.lit(False)).alias("stuck")))


def stuck_triggers(judged: DataFrame, chunk_sec: float = scan.HOUR) -> DataFrame:
    """First tick of each run of stuck ticks, for logs without clear events."""
    flagged = scan.running(judged, ROBOT, ["ts", "event_id"], scan.by_time("ts", chunk_sec), prev={"_was": "stuck"})
    return flagged.where(F.col("stuck") & ~F.coalesce("_was", F.lit(False))).drop("_was", "stuck")


def escalations(triggers: DataFrame, radius_m: float = _P.repeat_radius, window_sec: float = _P.repeat_window,
                reverse_m: float = _P.escape_reverse, suppress_sec: float = _P.escape_suppress,
                walk_speed: float = _P.walk_speed, chunk_sec: float = 24 * scan.HOUR) -> DataFrame:
    """Mark triggers close to the robot's previous one in time and space, and size the escape of each."""
    seen = scan.running(triggers, ROBOT, ["ts", "event_id"], scan.by_time("ts", chunk_sec),
                        prev={"_last": F.struct("ts", "x", "y")})
    gap = (scan.micros("ts") - scan.micros("_last.ts")) / 1_000_000
    repeat = F.coalesce((gap <= window_sec) & (distance("x", "y", "_last.x", "_last.y") <= radius_m), F.lit(False))
    factor = F.when(F.col("escalated"), 2.0).otherwise(1.0)
    return (seen.withColumn("escalated", repeat)
            .withColumns({"reverse_m": factor * reverse_m, "suppress_sec": factor * suppress_sec})
            .withColumn("reverse_cap_sec", 3.0 * (F.col("reverse_m") / max(walk_speed, 1e-3))).drop("_last"))


def suppressed(ticks: DataFrame, escapes: DataFrame, chunk_sec: float = scan.HOUR) -> DataFrame:
    """Flag ticks that fall before exit + suppression of the robot's latest escape; ``escapes(…, ts, suppress_sec)``."""
    until = scan.micros("ts") + (F.col("suppress_sec") * 1_000_000).cast("long")
    clock = _clock(escapes, 0, until=until).unionByName(_clock(ticks, 1), allowMissingColumns=True)
    known = scan.running(clock, ROBOT, ["ts", "kind", "tie"], scan.by_time("ts", chunk_sec), last={"until": "until"})
    return known.where("kind = 1").select(*ROBOT, "ts", F.col("tie").alias("event_id"),
                                          F.coalesce(scan.micros("ts") < F.col("until"), F.lit(False)).alias("suppressed"))


def behaviour_timeline(ticks: DataFrame, control_events: DataFrame, telemetry: DataFrame,
                       disperse_sec: float = _P.disperse_sec, comm_range: float = _P.comm_range,
                       bucket_sec: float = 8.0, chunk_sec: float = scan.HOUR) -> DataFrame:
    """State of each robot at each tick: disperse after a share, explore, or flock while peers are in range.

    ``control_events(run_id, robot_id, ts, event_id, control)`` with control 'share' or 'exit'. Ticks inside a recovery
    must already be removed.
    """
    ids = [*ROBOT, "ts", "event_id"]
    company = (contacts_at(ticks.select(*ids), telemetry, comm_range, bucket_sec, chunk_sec, "left_semi")
               .select(*ids).distinct().withColumn("has_peers", F.lit(True)))
    clock = (_clock(control_events, 0, event=F.struct("control", "ts"))
             .unionByName(_clock(ticks, 1), allowMissingColumns=True))
    known = scan.running(clock, ROBOT, ["ts", "kind", "tie"], scan.by_time("ts", chunk_sec), last={"event": "event"},
                         before={"_before": F.when(F.col("kind") == 1, F.col("ts"))})
    end = scan.micros("event.ts") + int(disperse_sec * 1_000_000)
    now, last_tick = scan.micros("ts"), scan.micros("_before")
    shared = F.coalesce(F.col("event.control") == "share", F.lit(False))
    leaving = last_tick.isNull() | (last_tick <= end)
    state = (F.when(shared & (now <= end), "disperse").when(shared & leaving, "explore")
             .when(F.col("has_peers"), "flock").otherwise("explore"))
    return (known.where("kind = 1").withColumn("event_id", F.col("tie")).join(company, ids, "left")
            .select(*ids, state.alias("state")))


def frozen_pairs(pair_distances: DataFrame, rows: int, tol: float) -> DataFrame:
    """Pairs whose distance stayed within ``tol`` over the trailing ``rows`` cycles, every one of which must be there.

    ``pair_distances(run_id, i, j, cycle, dist)``; a pair that was out of sight in one of these cycles is not frozen.
    """
    framed = scan.trailing_rows(pair_distances, ["run_id", "i", "j"], "cycle", rows,
                                {"_lo": F.min("dist"), "_hi": F.max("dist"), "_n": F.count("*")})
    spread = F.col("_hi") - F.col("_lo")
    return (framed.withColumns({"spread": spread, "frozen": (F.col("_n") == rows) & (spread < tol)})
            .drop("_lo", "_hi", "_n"))


def isolated_robots(robots: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Robots with no partner in range; ``pairs`` may be undirected."""
    keys = keys or ["run_id"]
    partnered = pairs.select(*keys, F.explode(F.array("i", "j")).alias("robot_id"))
    return robots.join(partnered, [*keys, "robot_id"], "left_anti")
