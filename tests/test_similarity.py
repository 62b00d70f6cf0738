import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetweave.operators import merging, similarity


def beliefs(spark, vectors, run="r"):
    return spark.createDataFrame([(run, i, list(map(float, v))) for i, v in enumerate(vectors)],
                                 "run_id string, robot_id int, z array<double>")


def random_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, d))
    out[n // 2] = 0.0
    return out


def matrix(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    return u @ u.T


def test_means_equal_the_matrix(spark):
    v = random_vectors(12, 5)
    m = matrix(v)
    off = ~np.eye(12, dtype=bool)
    agents = beliefs(spark, v)
    assert similarity.mean_similarity(agents).first().mean_sim == pytest.approx(m[off].mean())
    rows = {r.robot_id: r.row_mean for r in similarity.row_mean_similarity(agents).collect()}
    for i in range(12):
        assert rows[i] == pytest.approx(m[i][off[i]].mean())


def test_lonely_agent(spark):
    one = beliefs(spark, [[1.0, 0.0]])
    assert similarity.mean_similarity(one).first().mean_sim == 0.0
    assert similarity.row_mean_similarity(one).first().row_mean == 0.0


@pytest.mark.parametrize("slices", [2, 1024])
def test_requested_matrix(spark, slices):
    v = random_vectors(6, 4, 1)
    agents = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "agent_id int, z array<double>")
    order = [4, 0, 0, 3, 5]
    asked = [(1, k, a) for k, a in enumerate(order)] + [(2, 0, 1), (2, 1, 77)]
    requests = spark.createDataFrame(asked, "request_id int, ord int, agent_id int")
    cells, rejected = similarity.pairwise_similarity(agents, requests, slices)
    got = {(r.i, r.j): r.sim for r in cells.collect()}
    m = matrix(v)
    assert got.keys() == {(i, j) for i in range(5) for j in range(5)}
    assert all(got[i, j] == pytest.approx(m[order[i], order[j]]) for i, j in got)
    assert [(r.request_id, r.error) for r in rejected.collect()] == [(2, "similarity_query failed: 77")]


SHARED = "run_id string, i int, j int, ts timestamp, event_id long, sim double"


@pytest.mark.parametrize("sims, expected", [([0.9, 0.1], 0.65), ([0.9, 0.8], 0.20), ([0.55, 0.5], 0.40)])
def test_lowest_peer_decides(spark, at, sims, expected):
    rows = [("r", 0, j + 1, at(0), 0, s) for j, s in enumerate(sims)]
    assert similarity.share_retention(spark.createDataFrame(rows, SHARED)).first().retention == expected


def test_failed_refresh_keeps_the_old_value(spark, at):
    rows = [("r", 0, 1, at(0), 0, 0.55), ("r", 0, 2, at(0), 1, 0.5), ("r", 0, 1, at(9000), 2, None), ("r", 0, 2, at(9000), 3, None)]
    kept = similarity.carry_similarity(spark.createDataFrame(rows, SHARED)).where("event_id >= 2")
    got = similarity.share_retention(kept.drop("sim").withColumnRenamed("known_sim", "sim")).first()
    assert (got.min_sim, got.retention) == (0.5, 0.40)


def test_unknown_peer_counts_as_zero(spark):
    pairs = spark.createDataFrame([("r", 0, 1), ("r", 0, 9)], "run_id string, i int, j int")
    sims = similarity.peer_similarity(pairs, beliefs(spark, [[1.0, 0.0], [1.0, 0.0]]))
    assert similarity.share_retention(sims).first().min_sim == 0.0


@pytest.mark.parametrize("rows", [3, 4096])
def test_ordered_merge(spark, rows):
    rng = random.Random(9)
    start = {0: [1.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0]}
    events = [(rng.choice([0, 0, 0, 1]), seq, [rng.gauss(0, 1) for _ in range(3)]) for seq in range(20)]
    agents = spark.createDataFrame(list(start.items()), "agent_id int, z array<double>")
    df = spark.createDataFrame(events, "receiver_id int, seq long, r array<double>").repartition(5)
    got = {r.agent_id: r for r in merging.merge_reply(merging.merge_embeddings(agents, df, rows=rows)).collect()}
    for agent, z in start.items():
        z = np.array(z)
        for receiver, _, r in events:
            if receiver == agent:
                z = 0.7 * z + 0.3 * np.array(r)
                z = z / max(np.linalg.norm(z), 1e-8)
        assert np.allclose(got[agent].z_star, z) and abs(got[agent].z_norm - 1) < 1e-4 and got[agent].gate == 0.5
    assert got[2].n_folded == 0 and sum(r.n_folded for r in got.values()) == 20


def test_merge_counts_and_report(spark):
    heard = spark.createDataFrame([("r", 0, 1)] * 2 + [("r", 1, 2)] + [("s", 0, 1)], "run_id string, sender_id int, receiver_id int")
    report = merging.merge_report(merging.merge_counts(heard)).collect()
    assert {(r.run_id, r.sender_id, r.receiver_id, r.n_merges) for r in report} == {
        ("r", 0, 1, 2), ("r", 1, 2, 1), ("r", None, None, 3), ("s", 0, 1, 1), ("s", None, None, 1)}
    assert sum(r.is_total for r in report) == 2
