import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetweave.operators import motion

SAMPLES = "run_id string, robot_id int, ts timestamp, event_id long, x double, y double, speed double"


def judge(spark, at, samples, tick=100.0, clears=(), here=None, chunk=3600.0):
    rows = [("r", 0, at(t), i, x, y, v) for i, (t, x, y, v) in enumerate(samples)]
    df = spark.createDataFrame(rows, SAMPLES)
    poses = df if here is None else df.unionByName(spark.createDataFrame([("r", 0, at(tick), 99, *here, 0.0)], SAMPLES))
    ticks = spark.createDataFrame([("r", 0, at(tick), 0)], "run_id string, robot_id int, ts timestamp, event_id long")
    gone = spark.createDataFrame([("r", 0, at(t), 0) for t in clears], "run_id string, robot_id int, ts timestamp, event_id long")
    return motion.stuck(df, ticks, poses, 4.0, 0.05, gone, chunk).first().stuck


def aged(*samples):
    return [(100.0 - age, x, y, v) for age, x, y, v in samples]


STILL = aged((4.1, 0, 0, .15), (3.0, 0, 0, .15), (2.0, 0, 0, .15), (1.0, 0, 0, .15), (0.1, 0, 0, .15))


@pytest.mark.parametrize("chunk", [4.0, 3600.0])
def test_driven_but_still(spark, at, chunk):
    assert judge(spark, at, [tuple(map(float, s)) for s in STILL], chunk=chunk)


@pytest.mark.parametrize("samples", [
    aged((4.1, 0., 0., .15), (2.0, .2, 0., .15), (0.1, .5, 0., .15)), aged((4.1, 0., 0., .15), (2.0, 0., 0., 0.), (0.1, 0., 0., .15)),
    aged((1.0, 0., 0., .15), (0.5, 0., 0., .15)), aged((4.1, 0., 0., .15))])
def test_not_stuck(spark, at, samples):
    assert not judge(spark, at, samples)


def test_clears_empty_the_history(spark, at):
    samples = [tuple(map(float, s)) for s in STILL]
    assert not judge(spark, at, samples, clears=[98.5])
    assert judge(spark, at, samples, clears=[50.0])


def test_newest_pose_decides_the_displacement(spark, at):
    assert not judge(spark, at, [tuple(map(float, s)) for s in STILL], here=(1.0, 0.0))


def stuck_by_definition(history, tick):
    """Verdict on a tick of one robot: ``history`` is all that comes before it, (time, kind, event, x, speed) in order.

    The samples that count are those since the last clear that lie within four seconds of the newest of them. They must
    be two at least, reach back four seconds from the tick, and all have been driven; the newest pose must lie within
    five centimetres of the oldest of them.
    """
    cleared = max((k for k, row in enumerate(history) if row[1] == motion.CLEAR), default=-1)
    since = [row for row in history[cleared + 1:] if row[1] == motion.SAMPLE]
    poses = [row[3] for row in history if row[1] == motion.ODOM]
    counted = [row for row in since if Decimal(since[-1][0]) - Decimal(row[0]) <= 4]
    if len(counted) < 2 or not poses:
        return False
    oldest = min(counted, key=lambda row: (Decimal(row[0]), row[2]))
    return (Decimal(tick[0]) - Decimal(oldest[0]) >= 4 and all(row[4] > 0 for row in counted) and abs(poses[-1] - oldest[3]) < 0.05)


def test_random_histories_by_definition(spark, at):
    """Several robots, chunks much shorter than the histories, and every tick judged over the whole log before it."""
    rng = random.Random(23)
    logs, event = {robot: [] for robot in range(5)}, 0
    for robot, log in logs.items():
        tenths, x = 0, float(robot)
        for _ in range(130):
            tenths, event = tenths + rng.choice((2, 4, 7, 9)), event + 1
            x += 0.15 * (rng.random() < 0.05)
            kind = rng.choices((motion.ODOM, motion.SAMPLE, motion.TICK, motion.CLEAR), (3, 8, 4, 0.3))[0]
            log.append((f"{tenths / 10:.1f}", kind, event, x, 0.15 * (rng.random() > 0.02)))
    want = {row[2]: stuck_by_definition(log[:k], row) for log in logs.values() for k, row in enumerate(log) if row[1] == motion.TICK}
    rows = [("r", robot, at(float(t)), e, x, 0.0, v, kind) for robot, log in logs.items() for t, kind, e, x, v in log]
    df = spark.createDataFrame(rows, SAMPLES + ", kind int")
    of = lambda kind: df.where(F.col("kind") == kind).drop("kind")
    got = motion.stuck(of(motion.SAMPLE), of(motion.TICK), of(motion.ODOM), 4.0, 0.05, of(motion.CLEAR), 6.0).collect()
    assert {r.event_id: r.stuck for r in got} == want and 10 < sum(want.values()) < len(want) / 2


def test_first_tick_of_each_stuck_run_triggers(spark, at):
    flags = [False, True, True, False, True]
    rows = [("r", 0, at(2000 * i), i, f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "run_id string, robot_id int, ts timestamp, event_id long, stuck boolean")
    assert sorted(r.event_id for r in motion.stuck_triggers(df).collect()) == [1, 4]


@pytest.mark.parametrize("second, expected", [((20, 4.4, 0.3), True), ((20, 7.0, 0.0), False), ((61, 4.2, 0.0), False),
                                              ((60, 5.0, 0.0), True)])
def test_repeat_escapes(spark, at, second, expected):
    rows = [("r", 0, at(0), 0, 4.0, 0.0), ("r", 0, at(second[0]), 1, second[1], second[2])]
    df = spark.createDataFrame(rows, "run_id string, robot_id int, ts timestamp, event_id long, x double, y double")
    first, again = motion.escalations(df).orderBy("event_id").collect()
    assert not first.escalated and (first.reverse_m, first.suppress_sec) == (0.9, 4.0)
    assert first.reverse_cap_sec == pytest.approx(18.0)
    assert again.escalated is expected and (again.reverse_m, again.suppress_sec) == ((1.8, 8.0) if expected else (0.9, 4.0))


def test_suppression_span_is_open_at_its_end(spark, at):
    ids = "run_id string, robot_id int, ts timestamp, event_id long"
    ticks = spark.createDataFrame([("r", 0, at(t), t) for t in (9, 10, 13, 14)], ids)
    escapes = spark.createDataFrame([("r", 0, at(10), 0, 4.0)], ids + ", suppress_sec double")
    assert {r.event_id: r.suppressed for r in motion.suppressed(ticks, escapes).collect()} == {9: False, 10: True, 13: True, 14: False}


def test_behaviour_against_a_state_loop(spark, at):
    rng = random.Random(4)
    ids = "run_id string, robot_id int, ts timestamp, event_id long"
    log = sorted((round(rng.uniform(0, 400), 1), rng.choice(["tick", "tick", "tick", "share", "exit"]), i) for i in range(150))
    poses = sorted((round(rng.uniform(0, 400), 1), rng.choice([1.0, 9.0]), 1000 + i) for i in range(40))
    state, until, want = "explore", 0.0, {}
    for t, kind, event in log:
        company = ([x for s, x, _ in poses if s <= t] or [9.0])[-1] < 3.0
        if kind == "share":
            state, until = "disperse", t + 10
        elif kind == "exit":
            state = "explore"
        else:
            if state == "disperse":
                state = "explore" if t > until else "disperse"
            else:
                state = "flock" if company else "explore"
            want[event] = state
    ticks = spark.createDataFrame([("r", 0, at(t), e) for t, k, e in log if k == "tick"], ids)
    control = spark.createDataFrame([("r", 0, at(t), e, k) for t, k, e in log if k != "tick"], ids + ", control string")
    track = [("r", 0, at(0), 500, 0.0, 0.0)] + [("r", 1, at(t), e, x, 0.0) for t, x, e in poses]
    telemetry = spark.createDataFrame(track, ids + ", x double, y double")
    got = motion.behaviour_timeline(ticks, control, telemetry, bucket_sec=30.0, chunk_sec=60.0).collect()
    assert {r.event_id: r.state for r in got} == want and set(want.values()) == {"disperse", "explore", "flock"}


def test_frozen_and_isolated(spark):
    rows = [("r", 1, 4, c, 0.40 + (0.001 if c % 2 else 0)) for c in range(6)] + [("r", 0, 2, c, 2.0 + c) for c in range(6)]
    pairs = spark.createDataFrame(rows, "run_id string, i int, j int, cycle int, dist double")
    frozen = {(r.i, r.j, r.cycle) for r in motion.frozen_pairs(pairs, 4, 0.01).where("frozen").collect()}
    assert frozen == {(1, 4, 3), (1, 4, 4), (1, 4, 5)}
    robots = spark.createDataFrame([("r", i) for i in range(5)], "run_id string, robot_id int")
    assert [r.robot_id for r in motion.isolated_robots(robots, pairs).collect()] == [3]


def test_no_row_looks_at_its_whole_window(spark, at, monkeypatch):
    """A frame that slides over the window costs every row all rows of its window; running counts do not."""
    monkeypatch.setattr(motion, "cut_lineage", lambda df: df, raising=False)
    samples = spark.createDataFrame([("r", 0, at(0.5 * k), k, 0.0, 0.0, 0.15) for k in range(40)], SAMPLES)
    judged = motion.stuck(samples, samples, samples, 4.0, 0.05)
    assert "RangeFrame" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.stuck for r in judged.orderBy("ts").collect()] == [k >= 8 for k in range(40)]
