"""Merge counts over skipped cycles and midnight, pair lists, and merge requests that cannot be carried out."""
from datetime import timedelta

import pytest

from fleetweave.operators import convergence, merging
from fleetweave.plans import monitor


def test_merges_of_a_skipped_cycle_count_from_the_next_one_on(spark):
    cycles = spark.createDataFrame([("r", c) for c in (0, 2, 3, 4, 5)], "run_id string, cycle int")
    merges = spark.createDataFrame([("r", 1, 5), ("r", 3, 1)], "run_id string, cycle int, n long")
    found = {r["cycle"]: r["merges"] for r in merging.running_merges(cycles, merges).collect()}
    assert found == {0: 0, 2: 5, 3: 6, 4: 6, 5: 6}


def test_a_run_whose_merges_fell_into_a_skipped_cycle_converges(spark):
    rows = [("r", c, 10 * c, s) for c, s in ((0, 0.2), (2, 0.31), (3, 0.312), (4, 0.313), (5, 0.3135))]
    cycles = spark.createDataFrame(rows, "run_id string, cycle int, elapsed_sec int, mean_sim double")
    merges = spark.createDataFrame([("r", 1, 5)], "run_id string, cycle int, n long")
    judged = convergence.convergence(cycles.join(merging.running_merges(cycles, merges), ["run_id", "cycle"]))
    assert [r["cycle"] for r in judged.where("newly_converged").collect()] == [5]


def test_every_pair_so_far_is_listed_in_every_cycle(spark):
    cycles = spark.createDataFrame([("r", c) for c in (0, 1, 2, 4)] + [("s", 0)], "run_id string, cycle int")
    merges = spark.createDataFrame([("r", 1, 0, 7, 2), ("r", 3, 0, 7, 1), ("r", 2, 14, 0, 4), ("t", 0, 1, 2, 1)],
                                   "run_id string, cycle int, sender_id int, receiver_id int, n long")
    found = sorted(tuple(r)[1:] for r in merging.running_pairs(cycles, merges).collect())
    assert found == [(1, 0, 7, 2), (2, 0, 7, 2), (2, 14, 0, 4), (4, 0, 7, 3), (4, 14, 0, 4)]


def test_cycles_count_from_the_start_of_the_run_and_over_midnight(spark, at):
    begin = at(86400 - 30)
    rows = [("r", begin + timedelta(seconds=s), 1, 2) for s in (0, 9, 10, 29, 35, 86400)]
    heard = spark.createDataFrame(rows, "run_id string, ts timestamp, sender_id int, receiver_id int")
    starts = spark.createDataFrame([("r", begin)], "run_id string, start timestamp")
    found = {r["cycle"]: r["n"] for r in monitor.merge_cycles(heard, starts, 10).collect()}
    assert found == {0: 2, 1: 1, 2: 1, 3: 1, 8640: 1}


REQUESTS = [(1, 5, [0.0, 1.0], None), (1, 6, [0.0], "expected 2 values, got 1"), (1, 7, None, "no vector"),
            (1, 8, [float("nan"), 0.0], "not a number"), (1, 9, [None, 1.0], "not a number"), (3, 10, [1.0, 0.0], "unknown agent 3"),
            (None, 11, [1.0, 0.0], "unknown agent null")]


def test_faulty_merge_requests_have_a_text_and_change_no_belief(spark):
    agents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "agent_id int, z array<double>")
    events = spark.createDataFrame([r[:3] for r in REQUESTS], "receiver_id int, seq int, r array<double>")
    errors = {r["seq"]: r["error"] for r in merging.checked_merges(agents, events).collect()}
    assert errors == {seq: error for _, seq, _, error in REQUESTS}
    after = {r["agent_id"]: (r["n_folded"], r["z"]) for r in merging.merge_embeddings(agents, events).collect()}
    length = (0.7 ** 2 + 0.3 ** 2) ** 0.5
    assert after[1][0] == 1 and after[1][1] == pytest.approx([0.7 / length, 0.3 / length])
    assert after[2] == (0, [0.0, 1.0])


def test_traffic_counts_bytes(spark, at):
    shares = spark.createDataFrame([("r", 1, at(0), 4, "été→")], "run_id string, msg_id long, ts timestamp, sender_id int, payload string")
    nobody = spark.createDataFrame([], "run_id string, msg_id long")
    assert merging.share_traffic(shares, nobody).first()["bytes"] == len("été→".encode())


def test_a_pair_out_of_sight_is_not_frozen(spark):
    from fleetweave.operators import motion

    rows = [("r", 1, 2, c, 1.0) for c in (0, 1, 20, 21, 22, 23)]
    pairs = spark.createDataFrame(rows, "run_id string, i int, j int, cycle int, dist double")
    assert [r["cycle"] for r in motion.frozen_pairs(pairs, 4, 0.01).where("frozen").collect()] == [23]


def test_gaps_and_waits_follow_dispatched_goals(spark, at):
    from fleetweave.operators import goals

    rows = [(1, 1, at(0), at(50), "failed", True), (1, 2, at(60), at(60), "resent", False), (1, 3, at(90), at(300), "timed_out", True),
            (1, 4, at(320), at(330), "reached", True)]
    log = spark.createDataFrame(rows, "robot_id int, goal_num long, ts timestamp, end_ts timestamp, outcome string, dispatched boolean")
    assert {r["goal_num"]: r["gap_sec"] for r in goals.dispatch_gaps(log, 100.0).collect()} == {1: None, 3: 90.0, 4: 230.0}
    maps = spark.createDataFrame([(1, at(52)), (1, at(340))], "robot_id int, ts timestamp")
    assert {r["goal_num"]: r["stale"] for r in goals.stale_maps(log, maps).collect()} == {1: False, 4: True}


def test_finished_receivers_settle_once(spark, monkeypatch):
    """Forty receivers with one event, one with fifty, one with none, in rounds of four events."""
    from fleetweave.operators import folds
    agents = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(42)], "agent_id int, z array<double>")
    events = [(k, 0, [0.0, 1.0]) for k in range(40)] + [(40, s, [float(s % 3), 1.0]) for s in range(50)]
    events = spark.createDataFrame(events, "receiver_id int, seq long, r array<double>")
    sizes, plain = [], folds._step

    def counted(states, *args):
        sizes.append(states.count())
        return plain(states, *args)

    monkeypatch.setattr(folds, "_step", counted)
    got = {r.agent_id: (r.n_folded, r.z) for r in merging.merge_embeddings(agents, events, rows=4).collect()}
    assert sizes == [41] + [1] * 12
    monkeypatch.undo()
    want = {r.agent_id: (r.n_folded, r.z) for r in merging.merge_embeddings(agents, events).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)
