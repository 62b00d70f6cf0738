"""Positions as of a moment, and who is within range of whom."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.geometry import distance
from fleetweave.operators import scan
from fleetweave.session import cut_lineage, written

BLOCK = 4096
# Cell edge per unit of radius, just under 1/sqrt(2): two points of one cell are always in range, so the candidates
# a hot cell produces stay within a constant factor of the pairs it must report.
CELL_EDGE = 0.7071
# Cells of a join are somewhat wider than the radius, so all that a point reaches lies in nine. The points of
# a quarter of a cell are in range of each other, so candidates stay within a constant factor here too.
JOIN_EDGE = 1.1
FARTHEST = 2.0 ** 62  # cells are numbered by longs


def to_world(telemetry: DataFrame, robots: DataFrame) -> DataFrame:
    """World position = spawn offset + odometry; a robot without an offset keeps its odometry."""
    spawns = robots.select("robot_id", "spawn_x", "spawn_y")
    return (telemetry.join(spawns, "robot_id", "left")
            .withColumns({"x": F.coalesce("spawn_x", F.lit(0.0)) + F.col("odom_x"),
                          "y": F.coalesce("spawn_y", F.lit(0.0)) + F.col("odom_y")})
            .drop("spawn_x", "spawn_y"))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two event kinds on one clock: columns are aligned by name, ``kind`` 0 sorts before 1 at equal times."""
    return left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def latest_positions(telemetry: DataFrame) -> DataFrame:
    """Newest position per robot by (ts, event_id)."""
    newest = F.max_by(F.struct("x", "y", "ts"), F.struct("ts", "event_id"))
    return telemetry.groupBy("run_id", "robot_id").agg(newest.alias("p")).select("run_id", "robot_id", "p.*")


def positions_asof(telemetry: DataFrame, at: DataFrame, chunk_sec: float = scan.HOUR) -> DataFrame:
    """Position of ``at.robot_id`` at ``at.ts``: the latest at or before it, NULL when there is none.

    Keeps every column and row of ``at`` and adds x, y, seen_ts.
    """
    seen = telemetry.select("run_id", "robot_id", "ts", F.col("event_id").alias("_tie"),
                            F.struct("x", "y", F.col("ts").alias("seen_ts")).alias("_pos"))
    asked = at.select("run_id", "robot_id", "ts", F.struct(*at.columns).alias("_row"))
    clock = interleave(seen, asked)
    filled = scan.running(clock, ["run_id", "robot_id"], ["ts", "kind", "_tie"], scan.by_time("ts", chunk_sec),
                          last={"_at": "_pos"})
    return filled.where("kind = 1").select("_row.*", "_at.x", "_at.y", "_at.seen_ts")


def all_robots(robots: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Every robot, with or without a position."""
    return robots.join(positions, keys, "left")


def near(left: DataFrame, right: DataFrame, keys: list[str], radius: float, condition: Column | None = None,
         how: str = "inner", once: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Join points ``lx, ly`` with points ``rx, ry`` of the same ``keys`` at a distance strictly below ``radius``.

    Points meet in grid cells. Cells too full for one task are cut into ``block``-sized slices of both sides, every
    slice pair becoming its own join key. ``once=(l_id, r_id)`` visits each unordered pair once (both sides must be
    the same points). ``how`` is inner or left_semi; a semi join may repeat a left row, so deduplicate on its id. Points
    that are null, not finite or past ``FARTHEST`` cells are near nothing.
    """
    edge = radius * JOIN_EDGE
    spot = [*keys, "_cx", "_cy"]
    reach = range(-1, 2)
    steps = [(i, j) for i in reach for j in reach if once is None or (i, j) >= (0, 0)]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))

    def cell(df, x, y):
        known = df.where((F.abs(x) < edge * FARTHEST) & (F.abs(y) < edge * FARTHEST))
        return known.withColumns({"_cx": F.floor(F.col(x) / edge), "_cy": F.floor(F.col(y) / edge)})

    def spread(df):
        return (df.withColumn("_step", around)
                  .withColumns({"_cx": F.col("_cx") + F.col("_step.i"), "_cy": F.col("_cy") + F.col("_step.j"),
                                "_own": (F.col("_step.i") == 0) & (F.col("_step.j") == 0)}).drop("_step"))

    home, target = cell(left, "lx", "ly"), cell(right, "rx", "ry")
    reach_in = spread(home.groupBy(*spot).agg(F.count("*").alias("_n"))).groupBy(*spot).agg(F.sum("_n").alias("_nl"))
    held = target.groupBy(*spot).agg(F.count("*").alias("_nr"))
    hot = (reach_in.join(held, spot).where(F.col("_nl") * F.col("_nr") > block * block)
           .select(*spot, F.ceil(F.col("_nl") / block).alias("_kl"), F.ceil(F.col("_nr") / block).alias("_kr")))

    def slices(df, mine, other, own_slice, their_slice):
        pick = F.pmod(F.xxhash64(*df.columns), F.coalesce(mine, F.lit(1)))
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)
        return (df.join(hot, spot, "left").withColumn(own_slice, pick.cast("long"))
                  .withColumn(their_slice, F.explode(copies)).drop("_kl", "_kr"))

    a = slices(spread(home), F.col("_kl"), F.col("_kr"), "_sl", "_sr")
    b = slices(target, F.col("_kr"), F.col("_kl"), "_sr", "_sl")
    on = [*spot, "_sl", "_sr"]
    a, b = a.alias("a"), b.alias("b")
    test = distance("lx", "ly", "rx", "ry") < radius
    if once is not None:
        test = test & (~F.col("_own") | (F.col(once[0]) < F.col(once[1])))
    if condition is not None:
        test = test & condition
    equal = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    for e in equal:
        test = e & test
    joined = a.join(b, test, how)
    keep = [F.col(f"a.{k}") for k in keys] + [F.col(c) for c in left.columns if c not in keys]
    if how == "inner":
        keep += [F.col(c) for c in right.columns if c not in keys]
    return joined.select(*keep)


def in_range_pairs(positions: DataFrame, comm_range: float = 3.0, directed: bool = False,
                   keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of robots closer than ``comm_range``: i < j, or both directions."""
    keys = keys or ["run_id"]
    left = positions.select(*keys, F.col("robot_id").alias("_a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = positions.select(*keys, F.col("robot_id").alias("_b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    met = near(left, right, keys, comm_range, once=("_a", "_b"), block=block)
    dist = distance("lx", "ly", "rx", "ry").alias("dist")
    pairs = met.select(*keys, F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), dist)
    return both_ways(pairs, keys) if directed else pairs


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rest = [c for c in pairs.columns if c not in (*keys, "i", "j")]
    return pairs.select(*keys, ends.alias("_e"), *rest).select(*keys, "_e.i", "_e.j", *rest)


def contacts_at(events: DataFrame, telemetry: DataFrame, comm_range: float = 3.0, bucket_sec: float = 8.0,
                chunk_sec: float = scan.HOUR, how: str = "inner") -> DataFrame:
    """Other robots in range of ``events.robot_id`` at ``events.ts``, everyone at their latest known position.

    Each telemetry row holds from its time until the robot's next one. A span is covered by few blocks of buckets, each
    eight times as long as those of the level below, and an event looks up the one block of every level that holds it: a
    robot that is silent for a year costs tens of rows. Events meet spans in (cell, level, block).
    Returns the event columns with event position x, y and, for an inner join, peer_id and dist.
    """
    bucket = int(bucket_sec * 1_000_000)
    # Events are few against telemetry and visited several times below: written once instead of read or looked up again.
    events = written(events)
    own = cut_lineage(positions_asof(telemetry, events, chunk_sec).where(F.col("x").isNotNull()))
    asked = own.select(*own.columns, scan.micros("ts").alias("_at"), F.col("x").alias("lx"), F.col("y").alias("ly"))

    first, last = F.min(scan.micros("ts")), F.max(scan.micros("ts"))
    ends = own.groupBy("run_id").agg((last + 1).alias("_end"))
    reach = telemetry.groupBy("run_id").agg(first.alias("_start")).join(ends, "run_id").select(
        "run_id", scan.levels(F.col("_end") - F.col("_start"), bucket).alias("_top"))
    asked = (asked.join(reach, "run_id").withColumn("_level", F.explode(F.sequence(F.lit(0), "_top")))
             .withColumn("_bucket", scan.block_of(F.floor(F.col("_at") / bucket).cast("long"), F.col("_level"))).drop("_top"))
    spans = scan.following(telemetry.select("run_id", "robot_id", "ts", "event_id", "x", "y"), ["run_id", "robot_id"],
                           "ts", "event_id", chunk_sec, "_next", scan.micros("ts"))
    spans = (spans.join(ends, "run_id")
             .select("run_id", F.col("robot_id").alias("peer_id"), scan.micros("ts").alias("_from"),
                     F.least("_next", "_end").alias("_until"), F.col("x").alias("rx"), F.col("y").alias("ry"))
             .where("_from < _until")
             .withColumn("_block", F.explode(scan.cover(F.floor(F.col("_from") / bucket).cast("long"),
                                                        F.floor((F.col("_until") - 1) / bucket).cast("long"))))
             .select("*", F.col("_block.level").alias("_level"), F.col("_block.number").alias("_bucket")).drop("_block"))
    spans = written(spans)
    # An event is copied to the cells around it only in blocks that hold a span at all.
    taken = spans.select("run_id", "_level", "_bucket").distinct()
    asked = asked.join(taken, ["run_id", "_level", "_bucket"], "left_semi")
    valid = (F.col("peer_id") != F.col("robot_id")) & (F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_until"))
    met = near(asked, spans, ["run_id", "_level", "_bucket"], comm_range, valid, how)
    if how == "left_semi":
        return met.select(*own.columns)
    return met.select(*own.columns, "peer_id", distance("lx", "ly", "rx", "ry").alias("dist"))


def share_receivers(shares: DataFrame, telemetry: DataFrame, comm_range: float = 3.0, bucket_sec: float = 8.0,
                    chunk_sec: float = scan.HOUR) -> DataFrame:
    """Each good share message expanded to the robots that could hear it at that moment."""
    sent = shares.where("sender_id >= 0").select("run_id", F.col("sender_id").alias("robot_id"), "ts", "msg_id")
    heard = contacts_at(sent, telemetry, comm_range, bucket_sec, chunk_sec)
    return heard.select("run_id", "msg_id", "ts", F.col("robot_id").alias("sender_id"),
                        F.col("peer_id").alias("receiver_id"), "dist")


def peer_centroid(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """Centroid and number of the peers in range of each robot; ``pairs`` are directed."""
    peers = positions.select("run_id", F.col("robot_id").alias("j"), "x", "y")
    return (pairs.join(peers, ["run_id", "j"]).groupBy("run_id", F.col("i").alias("robot_id"))
            .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n_peers")))


def peers_in_range(pairs: DataFrame, robots: DataFrame, page_rows: int = 1024) -> DataFrame:
    """Ordered peers of each robot in pages of bounded length; a robot alone keeps one empty page 0.

    ``pairs`` are directed; ``robots`` holds (run_id, robot_id).
    """
    keys = ["run_id", "robot_id"]
    listed = pairs.select("run_id", F.col("i").alias("robot_id"), F.col("j").alias("peer_id"))
    counts = listed.groupBy(*keys).agg(F.count("*").alias("n_peers"))
    placed = scan.running(listed, keys, ["peer_id"], scan.by_number("peer_id"), total={"_pos": F.lit(1).cast("long")})
    pages = (placed.groupBy(*keys, F.floor((F.col("_pos") - 1) / page_rows).cast("long").alias("page"))
             .agg(F.array_sort(F.collect_list("peer_id")).alias("peers")))
    empty = F.array().cast(pages.schema["peers"].dataType)
    return (robots.select(*keys).join(counts, keys, "left").join(pages, keys, "left")
            .select(*keys, F.coalesce("n_peers", F.lit(0)).cast("long").alias("n_peers"),
                    F.coalesce("page", F.lit(0)).cast("long").alias("page"), F.coalesce("peers", empty).alias("peers")))
