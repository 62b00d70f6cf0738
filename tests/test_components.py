import random

import pytest

from fleetweave.operators import fragmentation
from fleetweave.operators.components import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def label(spark, graphs):
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in graphs.items() for n in ns], "g string, node long")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "g string, a long, b long")
    return {(r.g, r.node): r.component for r in components(nodes, edges, ["g"]).collect()}


def test_shapes(spark):
    rng = random.Random(8)
    path = list(range(60))
    rng.shuffle(path)
    graphs = {
        "path": (path, list(zip(path, path[1:]))),
        "star": (list(range(50)), [(49, i) for i in range(49)]),
        "alone": ([3, 5, 9], [(5, 5)]),
        "random": (list(range(80)), [(rng.randrange(80), rng.randrange(80)) for _ in range(70)])}
    got = label(spark, graphs)
    for g, (nodes, edges) in graphs.items():
        assert {n: got[g, n] for n in nodes} == union_find(nodes, edges), g


def test_contact_components_and_isolation(spark):
    pairs = spark.createDataFrame([("r", 1, 4), ("r", 0, 2)], "run_id string, i int, j int")
    robots = spark.createDataFrame([("r", i) for i in range(5)], "run_id string, robot_id int")
    got = {r.robot_id: (r.component, r.n_members, r.isolated) for r in fragmentation.contact_components(pairs, robots).collect()}
    assert got == {0: (0, 2, False), 2: (0, 2, False), 1: (1, 2, False), 4: (1, 2, False), 3: (3, 1, True)}


def test_union_connectivity(spark):
    pairs = spark.createDataFrame([("r", 0, 1, 5), ("r", 0, 1, 50), ("r", 1, 2, 20)], "run_id string, i int, j int, t int")
    robots = spark.createDataFrame([("r", i) for i in range(3)], "run_id string, robot_id int")
    got = {r["at"]: (r.n_components, r.connected) for r in fragmentation.union_connectivity(pairs, robots, [1, 5, 20]).collect()}
    assert got == {1: (3, False), 5: (2, False), 20: (1, True)}


def test_cluster_similarity(spark):
    vectors = {0: [1.0, 0.0], 1: [1.0, 1.0], 2: [0.0, 1.0], 3: [-1.0, 0.0]}
    parts = {0: 0, 1: 0, 2: 2, 3: 3}
    agents = spark.createDataFrame([("r", i, z) for i, z in vectors.items()], "run_id string, robot_id int, z array<double>")
    labels = spark.createDataFrame([("r", i, c) for i, c in parts.items()], "run_id string, robot_id int, component int")
    got = fragmentation.cluster_similarity(agents, labels).first()
    h = 2 ** -0.5
    assert got.n_components == 3 and got.within_sim == pytest.approx(h)
    assert got.between_sim == pytest.approx((0 - 1 + h - h + 0) / 5)


def test_the_forest_holds_first_contacts_that_join_parts(spark):
    """Against Kruskal's rule: contacts in time order, those kept that join two parts."""
    import random
    rng = random.Random(8)
    rows = [(run, *rng.sample(range(18), 2), rng.randrange(30)) for run in ("a", "b") for _ in range(25)]
    rows += [(r, j, i, t + 3) for r, i, j, t in rows[:9]] + [("a", 4, 4, 0), ("lone", 1, 2, 7)]
    pairs = spark.createDataFrame(rows, "run_id string, i int, j int, t int")
    got = sorted((r.run_id, r.t, r.i, r.j) for r in fragmentation.first_contact_forest(pairs, ["run_id"]).collect())
    want, label = [], {}
    for run, t, i, j in sorted((r, t, min(i, j), max(i, j)) for r, i, j, t in rows):
        a, b = label.setdefault((run, i), i), label.setdefault((run, j), j)
        if a != b:
            want.append((run, t, i, j))
            label = {k: a if k[0] == run and v == b else v for k, v in label.items()}
    assert got == want
    robots = spark.createDataFrame([(run, k) for run in ("a", "b", "lone", "none") for k in range(18)], "run_id string, robot_id int")
    found = fragmentation.union_connectivity(pairs, robots, list(range(-1, 34)))
    counts = {(r.run_id, r.at): (r.n_components, r.connected) for r in found.collect()}
    assert len(counts) == 4 * 35 and all(counts[run, t][0] == 18 - sum(1 for r, x, *_ in want if r == run and x <= t) for run, t in counts)
    assert fragmentation.first_contact_forest(pairs.where("false"), ["run_id"]).count() == 0
