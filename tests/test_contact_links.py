"""Links against the pairs in range: the same parts of the fleet, every link a pair, far fewer rows where cells are full."""
import random

import pytest
from pyspark.sql import functions as F

from fleetweave.operators import fragmentation, motion, proximity
from fleetweave.operators.contact_links import contact_links

SCHEMA = "run_id string, robot_id int, x double, y double"


def parts(robots, pairs):
    return sorted((r.run_id, r.robot_id, r.component, r.isolated) for r in fragmentation.contact_components(pairs, robots).collect())


@pytest.fixture(scope="module")
def crowds(spark):
    """Runs of any density, with repeated places, a grid whose neighbours are exactly out of range, and unknown positions."""
    rng = random.Random(17)
    rows = [(f"spread{w}", i, rng.uniform(-w, w), rng.uniform(-w, w)) for w in (3, 8, 20) for i in range(90)]
    rows += [("clumps", i, 2.9 * (i % 7) + rng.gauss(0, 0.05), 3.02 * (i % 5) + rng.gauss(0, 0.05)) for i in range(140)]
    rows += [("grid", i, 3.0 * (i % 6), 3.0 * (i // 6)) for i in range(36)] + [("grid", 40, 1.5, 0.0)]
    rows += [("same", i, 1e6 + 2.5 * (i % 2), -1e6) for i in range(40)]
    rows += [("odd", 0, None, 0.0), ("odd", 1, float("nan"), 0.0), ("odd", 2, float("inf"), 0.0), ("odd", 3, 0.0, 0.0), ("odd", 4, float("nan"), 0.0), ("odd", 5, 1e300, 0.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("direct", [0, 16])
def test_links_join_what_pairs_join(spark, crowds, direct):
    robots, pairs = crowds.select("run_id", "robot_id"), proximity.in_range_pairs(crowds).cache()
    links = contact_links(crowds, 3.0, direct=direct).cache()
    assert parts(robots, links) == parts(robots, pairs)
    assert sorted(motion.isolated_robots(robots, links).collect()) == sorted(motion.isolated_robots(robots, pairs).collect())
    assert links.groupBy("run_id").count().where("count > 1000").count() == 0 and links.where("i >= j").count() == 0
    # a link may name the smallest ids of two cells in contact, so each is at least within the same part
    assert links.count() < pairs.count()


@pytest.mark.parametrize("gap, joined", [(1e-9, False), (-1e-9, True)])
def test_two_full_cells_cost_rows_in_proportion(spark, gap, joined):
    """Twice ten thousand robots, whose nearest places lie a billionth off the range."""
    n = 10_000
    side = lambda sign, first: spark.range(n).select(
        F.lit("r").alias("run_id"), (F.col("id") + first).cast("int").alias("robot_id"),
        (sign * (1.5 + gap / 2 + F.when(F.col("id") == 7, 0.0).otherwise(0.001 + 0.5 * F.rand(3)))).alias("x"),
        F.when(F.col("id") == 7, 1.0).otherwise(0.1 + 1.8 * F.rand(5)).alias("y"))
    crowd = side(1, 0).unionByName(side(-1, n))
    robots = crowd.select("run_id", "robot_id")
    links = contact_links(crowd, 3.0).cache()
    assert links.count() < 2.1 * n
    assert fragmentation.contact_components(links, robots).select("component").distinct().count() == (1 if joined else 2)


def test_no_positions(spark):
    assert contact_links(spark.createDataFrame([], SCHEMA)).collect() == []
