import math
import random

import pytest
from pyspark.sql import functions as F

from fleetweave.functions import geometry
from fleetweave.operators import proximity


def positions(spark, points, run="r"):
    return spark.createDataFrame([(run, i, x, y) for i, (x, y) in enumerate(points)],
                                 "run_id string, robot_id int, x double, y double")


def test_range_is_strict(spark):
    spots = [(0.0, 0.0), (1.0, 1.0), (3.0, 0.0), (3.0 - 1e-6, 0.0), (10.0, 10.0)]
    got = {(r.i, r.j) for r in proximity.in_range_pairs(positions(spark, spots)).collect()}
    assert {p for p in got if 0 in p} == {(0, 1), (0, 3)}


def test_unknown_position_has_no_pairs_and_sentinel_distance(spark):
    df = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, None, None)], "run_id string, robot_id int, x double, y double")
    assert proximity.in_range_pairs(df).count() == 0
    gaps = df.select(geometry.distance_or_unknown(F.lit(0.0), F.lit(0.0), "x", "y").alias("d")).collect()
    assert sorted(r.d for r in gaps) == [0.0, 999.0]
    assert spark.range(1).select(geometry.distance(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(6.0)).alias("d")).first().d == 5.0


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_pairs_match_brute_force_with_a_crowded_cell(spark, block):
    rng = random.Random(3)
    points = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(40)]
    points += [(rng.uniform(-15, 15), rng.uniform(-15, 15)) for _ in range(80)]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if math.dist(points[i], points[j]) < 3.0}
    got = [(r.i, r.j) for r in proximity.in_range_pairs(positions(spark, points), block=block).collect()]
    assert len(got) == len(want) and set(got) == want
    both = proximity.in_range_pairs(positions(spark, points), directed=True, block=block)
    assert both.count() == 2 * len(want)


def test_spawn_offsets(spark):
    rows = [("r", 0, 1.0, 0.5), ("r", 1, 0.5, -0.5), ("r", 2, 1.0, 2.0), ("r", 3, 7.0, 8.0)]
    odom = spark.createDataFrame(rows, "run_id string, robot_id int, odom_x double, odom_y double")
    spawns = spark.createDataFrame([(0, 3.0, -2.0), (1, -1.0, 5.0), (2, 4.0, 0.0)], "robot_id int, spawn_x double, spawn_y double")
    got = {r.robot_id: (r.x, r.y) for r in proximity.to_world(odom, spawns).collect()}
    assert got == {0: (4.0, -1.5), 1: (-0.5, 4.5), 2: (5.0, 2.0), 3: (7.0, 8.0)}


def track(spark, at, seed=1, n=120):
    rng = random.Random(seed)
    rows = [("r", rng.randrange(6), at(rng.randrange(0, 7200)), i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id string, robot_id int, ts timestamp, event_id long, x double, y double")


def known(rows, robot, when):
    past = [(r[2], r[3], r[4], r[5]) for r in rows if r[1] == robot and r[2] <= when]
    return max(past)[2:] if past else None


@pytest.mark.parametrize("chunk", [600.0, 36000.0])
def test_positions_asof(spark, at, chunk):
    rows, telemetry = track(spark, at)
    asked = [("r", i % 7, at(60 * i), i) for i in range(100)]
    df = spark.createDataFrame(asked, "run_id string, robot_id int, ts timestamp, q long")
    got = {r.q: (r.x, r.y) if r.x is not None else None for r in proximity.positions_asof(telemetry, df, chunk).collect()}
    assert got == {q: known(rows, robot, when) for _, robot, when, q in asked}


@pytest.mark.parametrize("bucket", [100.0, 1800.0])
def test_share_receivers_match_brute_force(spark, at, bucket):
    rows, telemetry = track(spark, at, 2)
    sends = [("r", i % 8 - 1, at(70 * i + 5), i) for i in range(100)]
    shares = spark.createDataFrame(sends, "run_id string, sender_id int, ts timestamp, msg_id long")
    want = set()
    for _, sender, when, msg in sends:
        here = known(rows, sender, when) if sender >= 0 else None
        for peer in range(6):
            there = known(rows, peer, when)
            if here and there and peer != sender and math.dist(here, there) < 3.0:
                want.add((msg, sender, peer))
    got = [(r.msg_id, r.sender_id, r.receiver_id)
           for r in proximity.share_receivers(shares, telemetry, 3.0, bucket, 600.0).collect()]
    assert len(got) == len(want) and set(got) == want


def test_peers_in_range_pages(spark):
    crowd = positions(spark, [(0.01 * i, 0.0) for i in range(25)] + [(50.0, 50.0)])
    pairs = proximity.in_range_pairs(crowd, directed=True)
    pages = proximity.peers_in_range(pairs, crowd, page_rows=10).collect()
    first = sorted((r.page, r.peers) for r in pages if r.robot_id == 0)
    assert [p for _, p in first] == [list(range(1, 11)), list(range(11, 21)), list(range(21, 25))]
    assert [(r.n_peers, r.page, r.peers) for r in pages if r.robot_id == 25] == [(0, 0, [])]
    assert all(r.n_peers == 24 for r in pages if r.robot_id < 25)


def test_headings(spark):
    row = spark.range(1).select(
        geometry.yaw(F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.4)), F.lit(math.cos(0.4))).alias("yaw"),
        geometry.angle_diff(F.lit(3.0), F.lit(-3.0)).alias("diff"), geometry.near_wall(F.lit(9.6), F.lit(0.0)).alias("wall"),
        geometry.near_wall(F.lit(9.5), F.lit(-9.5)).alias("edge")).first()
    assert row.yaw == pytest.approx(0.8) and row.diff == pytest.approx(6.0 - 2 * math.pi) and row.wall and not row.edge


def test_a_robot_silent_for_a_year_costs_few_rows(spark, at):
    """Default bucket of eight seconds: the year would be four million buckets."""
    year = 365 * 24 * 3600
    poses = [("r", 0, at(0), 1, 0.0, 0.0), ("r", 1, at(0), 2, 1.0, 0.0), ("r", 2, at(1), 3, 50.0, 0.0), ("r", 2, at(year), 4, 0.0, 1.0)]
    telemetry = spark.createDataFrame(poses, "run_id string, robot_id int, ts timestamp, event_id long, x double, y double")
    shares = spark.createDataFrame([("r", 0, at(t), k) for k, t in enumerate((0, 7, 40_000, year - 1, year + 1))],
                                   "run_id string, sender_id int, ts timestamp, msg_id long")
    heard = proximity.share_receivers(shares, telemetry)
    want = [(k, 1) for k in range(5)] + [(4, 2)]
    assert sorted((r.msg_id, r.receiver_id) for r in heard.collect()) == want
