import math

import pytest

from fleetweave.operators import frontiers, goals
from fleetweave.plans.frontier_targets import frontier_targets

GRID = ("map_id long, seq long, width int, height int, resolution double, origin_x double, origin_y double, "
        "data array<tinyint>")


def grid(spark, *pictures):
    """Pictures use . for free, ? for unknown, # for occupied."""
    codes = {".": 0, "?": -1, "#": 100, "f": 49, "o": 50}
    rows = []
    for i, lines in enumerate(pictures):
        rows.append((i, 0, len(lines[0]), len(lines), 1.0, 0.0, 0.0, [codes[c] for line in lines for c in line]))
    return spark.createDataFrame(rows, GRID)


def clusters(spark, *pictures):
    g = grid(spark, *pictures)
    frontier = frontiers.grid_frontier(g)
    joined = frontiers.frontier_cells(frontiers.grid_cells(g), g)
    assert sorted(joined.select(frontier.columns[:2] + ["cell"]).collect()) == sorted(
        frontier.select(frontier.columns[:2] + ["cell"]).collect())
    found = {}
    for r in frontiers.frontier_clusters(frontier).collect():
        found.setdefault((r.map_id, r.cluster_id), set()).add((r.x, r.y))
    return found


def test_small_grid_has_none(spark):
    assert clusters(spark, [".....", "?????"]) == {}


def test_block_beside_an_unknown_column(spark):
    assert clusters(spark, ["....?", "....?", "....?", "....?"]) == {(0, 8): {(3, 1), (3, 2)}}


def test_corner_contact_joins(spark):
    picture = ["......", ".#.?..", "..?...", ".#..#.", "......"]
    (cells,) = clusters(spark, picture).values()
    assert cells == {(2, 1), (4, 1), (1, 2), (3, 2), (2, 3)}


def test_free_and_occupied_thresholds_and_border_unknowns(spark):
    got = clusters(spark, [".?..", ".f..", ".o..", ".?.."])
    assert got == {(0, 5): {(1, 1)}}


def test_small_clusters_vanish(spark):
    three = ["?????", "?...?", "?????"]
    four = ["??????", "?....?", "??????"]
    g = grid(spark, three, four)
    targets = frontiers.cluster_centroids(frontiers.frontier_clusters(frontiers.grid_frontier(g)), g).collect()
    assert [(r.map_id, r.n_cells, r.tx, r.ty) for r in targets] == [(1, 4, 3.0, 1.5)]


TARGETS = "map_id long, seq long, cluster_id long, tx double, ty double, n_cells long"


def choose(spark, spots, robot=(0.0, 0.0), banned=()):
    robots = spark.createDataFrame([(1, 0, 7, *robot)], "map_id long, seq long, robot_id long, x double, y double")
    targets = spark.createDataFrame([(1, 0, i, float(x), float(y), 5) for i, (x, y) in enumerate(spots)], TARGETS)
    points = spark.createDataFrame([(1, 0, x, y) for x, y in banned], "map_id long, seq long, bx double, by double")
    return goals.next_targets(robots, targets, points).collect()


def test_nearest_far_target_wins(spark):
    (r,) = choose(spark, [(0.3, 0.0), (5.0, 0.0), (0.0, 0.5)])
    assert (r.gx, r.gy, r.projected) == (0.0, 0.5, False)


def test_only_close_targets_are_projected(spark):
    (r,) = choose(spark, [(0.3, 0.0), (0.0, 0.4)])
    assert (r.gx, r.gy) == (pytest.approx(0.7), 0.0) and (r.fx, r.fy) == (0.3, 0.0) and r.projected


def test_no_heading_means_no_goal(spark):
    assert choose(spark, [(0.005, 0.0), (0.3, 0.0)]) == []
    assert len(choose(spark, [(0.005, 0.0), (2.0, 0.0)])) == 1


def test_blacklist_radius_is_strict(spark):
    (r,) = choose(spark, [(1.0, 0.0), (3.0, 0.0)], banned=[(1.0, 0.39)])
    assert r.fx == 3.0
    (r,) = choose(spark, [(1.0, 0.0), (3.0, 0.0)], banned=[(1.0, 0.4)])
    assert r.fx == 1.0


def test_progress(spark):
    targets = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 5), (2, 0, 0, 1.0, 0.0, 5)], TARGETS)
    banned = spark.createDataFrame([(1, 0, 1.1, 0.0)], "map_id long, seq long, bx double, by double")
    maps = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "map_id long, seq long")
    got = {r.map_id: (r.n_left, r.complete) for r in goals.exploration_progress(targets, banned, maps).collect()}
    assert got == {1: (0, True), 2: (1, False), 3: (0, True)}


def test_whole_chain(spark):
    g = grid(spark, ["??????", "?....?", "??????"])
    robots = spark.createDataFrame([(0, 0, 0, 0.0, 1.5)], "map_id long, seq long, robot_id long, x double, y double")
    (r,) = frontier_targets(g, robots).collect()
    assert (r.gx, r.gy, r.n_cells) == (3.0, 1.5, 4)


LOG = ("robot_id int, goal_num long, ts timestamp, gx double, gy double, fx double, fy double, sx double, sy double, "
       "ex double, ey double, result string, end_ts timestamp")


def goal(at, n, x, took=10, moved=1.0, result="succeeded", robot=0):
    return (robot, n, at(300 * n), float(x), 0.0, float(x), 0.0, 0.0, 0.0, float(moved), 0.0, result, at(300 * n + took))


def test_outcomes(spark, at):
    log = [goal(at, 0, 0.0), goal(at, 1, 0.15), goal(at, 2, 0.25), goal(at, 3, 5.0, took=121), goal(at, 4, 9.0, moved=0.05),
           goal(at, 5, 13.0, result="failed"), goal(at, 6, 17.0, took=120, moved=0.1)]
    got = {r.goal_num: (r.outcome, r.blacklisted) for r in goals.goal_outcomes(spark.createDataFrame(log, LOG)).collect()}
    assert got == {0: ("reached", False), 1: ("resent", True), 2: ("reached", False), 3: ("timed_out", True),
                   4: ("no_motion", True), 5: ("failed", True), 6: ("reached", False)}


@pytest.mark.parametrize("rows", [3, 512])
def test_dispatch_chain_against_a_loop(spark, at, rows):
    """A skipped candidate never becomes the reference point, also across rounds of a long segment."""
    log, want = [], {}
    for robot in range(2):
        last = None
        for n in range(40):
            x = 0.07 * n if robot else (n % 3) * 0.15
            log.append(goal(at, n, x, robot=robot))
            want[robot, n] = last is None or math.hypot(x - last, 0.0) >= 0.2
            last = x if want[robot, n] else last
    got = goals.with_dispatched(spark.createDataFrame(log, LOG), rows=rows).collect()
    assert {(r.robot_id, r.goal_num): r.dispatched for r in got} == want


def test_gaps_and_stale_maps(spark, at):
    log = spark.createDataFrame([goal(at, 0, 0), goal(at, 1, 1), goal(at, 2, 2)], LOG)
    gaps = {r.goal_num: (r.gap_sec, r.too_soon) for r in goals.dispatch_gaps(log, 301.0).collect()}
    assert gaps == {0: (None, False), 1: (300.0, True), 2: (300.0, True)}
    maps = spark.createDataFrame([(0, at(0)), (0, at(15)), (0, at(316))], "robot_id int, ts timestamp")
    stale = {r.goal_num: r.stale for r in goals.stale_maps(log, maps).collect()}
    assert stale == {0: False, 1: True, 2: True}


def test_bans_hold_for_one_robot_and_later_choices(spark, at):
    """Robots 1 and 2 share a map; robot 1 has tried the nearest target before its second choice only."""
    targets = spark.createDataFrame([(0, 0, 10, 2.0, 0.0, 5), (0, 0, 11, 3.0, 0.0, 5), (0, 0, 12, 9.0, 0.0, 5)],
                                    "map_id int, seq int, cluster_id long, tx double, ty double, n_cells long")
    bans = spark.createDataFrame([(1, 2.1, 0.1, at(50)), (1, 2.1, 0.1, at(90)), (1, 3.0, 0.39, at(70)), (2, 9.0, 0.0, at(0)), (3, 2.0, 0.4, at(0))],
                                 "robot_id int, bx double, by double, ts timestamp")
    choose = lambda t: spark.createDataFrame([(0, 0, k, at(t), 0.0, 0.0) for k in (1, 2, 3)],
                                             "map_id int, seq int, robot_id int, ts timestamp, x double, y double")
    got = {t: {r.robot_id: r.cluster_id for r in goals.next_targets(choose(t), targets, bans).collect()} for t in (40, 50, 60, 80)}
    assert got == {40: {1: 10, 2: 10, 3: 10}, 50: {1: 10, 2: 10, 3: 10}, 60: {1: 11, 2: 10, 3: 10}, 80: {1: 12, 2: 10, 3: 10}}


def test_a_log_of_goals_bans_points_once_they_ended(spark, at):
    log = [(1, 1, at(0), 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, "failed", at(30)), (1, 2, at(40), 1.05, 0.0, 1.05, 0.0, 0.0, 0.0, 1.0, 0.0, "succeeded", at(60)),
           (1, 3, at(70), 5.0, 0.0, 5.0, 0.0, 0.0, 0.0, 4.0, 0.0, "succeeded", at(80))]
    frame = spark.createDataFrame(log, "robot_id int, goal_num long, ts timestamp, gx double, gy double, fx double, fy double, sx double, sy double, "
                                       "ex double, ey double, result string, end_ts timestamp")
    got = {(r.bx, r.ts.replace(tzinfo=None)) for r in goals.timed_blacklist(goals.goal_outcomes(frame)).collect()}
    assert got == {(1.0, at(30).replace(tzinfo=None)), (1.05, at(40).replace(tzinfo=None))}
