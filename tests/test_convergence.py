import math

import pytest
from pyspark.sql import functions as F

from fleetweave.functions import labels
from fleetweave.operators import convergence
from fleetweave.params import RETENTION_BANDS, RETENTION_ELSE


def verdicts(spark, sims, merges=1, run="r"):
    rows = [(run, i, i * 10, float(s), merges) for i, s in enumerate(sims)]
    cycles = spark.createDataFrame(rows, "run_id string, cycle int, elapsed_sec int, mean_sim double, merges long")
    return convergence.convergence(cycles).orderBy("cycle").collect()


def definition(sims, merges, rise=0.03, eps=0.005, needed=3):
    """First cycle that ends ``needed`` steady steps, above the first reading by ``rise``, after some merge."""
    for k in range(needed, len(sims)):
        steady = all(abs(sims[j] - sims[j - 1]) < eps for j in range(k - needed + 1, k + 1))
        if steady and sims[k] - sims[0] >= rise and merges > 0:
            return k
    return None


@pytest.mark.parametrize("sims, merges", [
    ([0.25, 0.61, 0.612, 0.609, 0.611, 0.61], 7), ([0.25, 0.61, 0.612, 0.609, 0.611, 0.61], 0),
    ([0.3, 0.301, 0.302, 0.303], 2), ([0.8, 0.2, 0.2, 0.2, 0.2], 3), ([0.2, 0.5, 0.504, 0.52, 0.523, 0.524, 0.5235], 1),
    ([0.6], 1), ([0.1 * (-1) ** k for k in range(9)], 4), ([0.0, 0.05, 0.0504, 0.0507, 0.0511], 9)])
def test_decision(spark, sims, merges):
    rows, expected = verdicts(spark, sims, merges), definition(sims, merges)
    assert [r.cycle for r in rows if r.newly_converged] == ([] if expected is None else [expected])
    assert [r.converged for r in rows] == [expected is not None and r.cycle >= expected for r in rows]


def test_single_steps(spark):
    rows = verdicts(spark, [0.31, 0.40, 0.404, 0.401, 0.39])
    assert [r.stable for r in rows] == [0, 0, 1, 2, 0]
    assert rows[0].delta == 0.0 and not rows[0].has_prev and rows[3].rise == pytest.approx(0.091)


def test_latch_survives_a_drop(spark):
    rows = verdicts(spark, [0.1, 0.2, 0.2, 0.2, 0.2, 0.05, 0.05, 0.3, 0.3, 0.3, 0.3])
    assert sum(r.newly_converged for r in rows) == 1 and all(r.converged for r in rows if r.cycle >= 4)


def test_min_rise_is_inclusive_in_doubles(spark):
    level = 0.25 + 0.03
    assert level - 0.25 >= 0.03
    assert verdicts(spark, [0.25] + [level] * 4)[-1].converged


def test_skipped_cycles_do_not_break_the_run(spark):
    rows = [("r", c, c * 10, s, 1) for c, s in ((0, 0.1), (1, 0.2), (5, 0.2), (9, 0.2), (10, 0.2))]
    cycles = spark.createDataFrame(rows, "run_id string, cycle int, elapsed_sec int, mean_sim double, merges long")
    assert convergence.run_summary(cycles).first().converged_cycle == 10


def test_retention_bands(spark):
    """On, just above and just below every border of the table, and far from all of them."""
    borders = [low for low, _ in RETENTION_BANDS]
    points = {x for b in borders for x in (b, math.nextafter(b, 2), math.nextafter(b, -2))} | {-0.83, 0.05, 0.61, 0.97}
    rows = spark.createDataFrame([(x,) for x in points], "s double").select("s", labels.retention_band("s").alias("r"))
    for r in rows.collect():
        assert r.r == next((share for low, share in RETENTION_BANDS if r.s > low), RETENTION_ELSE)


def test_trend_and_colour(spark):
    got = spark.createDataFrame([(0.005,), (0.0051,), (-0.0051,), (0.0,)], "d double").select(labels.trend("d").alias("t"))
    assert [r.t[0] for r in got.collect()] == ["→", "↑", "↓", "→"]
    c = spark.range(1).select(labels.sim_colour(F.lit(3.0)).alias("c")).first().c
    assert (c.r, c.g, c.b) == (0.0, 1.0, 0.0)


def test_trajectory_metrics(spark):
    rows = [("a", i, i * 10, s) for i, s in enumerate([0.1, 0.5, 0.5, 0.4, 0.3])] + [("b", 0, 0, 0.2)]
    cycles = spark.createDataFrame(rows, "run_id string, cycle int, elapsed_sec int, mean_sim double")
    runs = spark.createDataFrame([("a", 5, 1), ("b", 3, 1)], "run_id string, n_robots int, seed int")
    got = {(r.n_robots, r.seed): r for r in convergence.trajectory_metrics(cycles, runs).collect()}
    assert got[5, 1].time_to_peak == 10 and got[5, 1].post_peak_slope == pytest.approx(-0.01) and got[5, 1].final_sim == 0.3
    assert got[3, 1].post_peak_slope is None and got[None, None].n_runs == 2


def test_duplicate_writers(spark):
    rows = spark.createDataFrame([("k", "s1"), ("k", "s2"), ("k", "s2"), ("l", "s1")], "key string, server string")
    got = {r.key: (r.n_writers, r.suspect) for r in convergence.duplicate_writers(rows, ["key"], "server").collect()}
    assert got == {"k": (2, True), "l": (1, False)}
