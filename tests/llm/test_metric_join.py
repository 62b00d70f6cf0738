"""The metric join against all pairs, over data with and without structure, hot cells and awkward vectors."""
import numpy as np
import pytest

from compare import connect, differences
from fleetweave.llm import metric_join
from fleetweave.llm.queries import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def brute(rows, least):
    """(id, n_links, component_id, kept) by the definition; rows are (id, vector)."""
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, usable)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                near[a, b] = near[b, a] = True
    label = np.arange(n)
    while True:
        new = np.array([min(label[a], label[near[a]].min(initial=n)) for a in range(n)])
        if (new == label).all():
            break
        label = new
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(n) if label[b] == label[a] and rows[b][0] is not None]
        out.append((i, int(near[a].sum()), min(ids, default=None), i is not None and i == min(ids)))
    return sorted(out, key=str)


def ours(spark, rows, kind="float", least=0.95):
    data = [(i, v, 3, "x", 1) for i, v in rows]
    docs = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, node int, key string, weight int")
    return sorted((tuple(r) for r in metric_join.near_duplicates(docs, least=least).collect()), key=str)


def test_the_query_against_sql(spark):
    assert differences(spark, connect(PATH), PATH, "op12", QUERIES["op12_metric_join"], ORACLES["op12_metric_join"]) == []


def clouds(draw, dims=6):
    """Random vectors, dense balls, chains, copies, and neighbours just around the threshold."""
    rows = [draw.normal(size=dims) for _ in range(150)]
    for k in range(4):
        centre = draw.normal(size=dims)
        rows += [centre + 0.1 * np.linalg.norm(centre) * draw.normal(size=dims) / np.sqrt(dims) for _ in range(60)]
    a, b = draw.normal(size=(2, dims))
    a, b = a / np.linalg.norm(a), b - (a @ b) / (a @ a) * a
    b /= np.linalg.norm(b)
    step = np.arccos(0.95)
    rows += [np.cos(k * step * 0.999) * a + np.sin(k * step * 0.999) * b for k in range(15)]
    rows += [rows[0], rows[0], 3 * rows[0], -rows[0]]
    return [(k * 7 % 1009, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("size, cell, fewest", [(8192, 8192, 8), (20, 30, 8), (8192, 8192, 1), (50, 8192, 2)])
def test_cells_and_slices_against_all_pairs(spark, monkeypatch, size, cell, fewest):
    for name, value in (("SLICE", size), ("CELL", cell), ("FEWEST", fewest), ("ROWS", 64)):
        monkeypatch.setattr(metric_join, name, value)
    rows = clouds(np.random.default_rng(5))
    found = ours(spark, rows)
    assert found == brute(rows, 0.95)
    assert max(r[1] for r in found) > 50 and len({r[2] for r in found}) > 60


def test_a_third_of_all_rows_in_one_ball_and_as_copies(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "SLICE", 40)
    draw = np.random.default_rng(2)
    centre = draw.normal(size=16)
    rows = [(k, [float(x) for x in draw.normal(size=16)]) for k in range(120)]
    rows += [(200 + k, [float(x) for x in centre + 0.05 * draw.normal(size=16)]) for k in range(120)]
    rows += [(400 + k, rows[3][1]) for k in range(120)]
    assert ours(spark, rows, "double") == brute(rows, 0.95)


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, NAN]), (5, [INF, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [5.0, 0.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1e300, 1e299]), (11, [1e-300, 1e-301]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, -1.0]),
            (None, [0.0, 0.0, -1.0]), (None, None), (14, [3.0]), (14, [3.0]), (15, [-3.0]), (1, None)]
    assert ours(spark, rows, "double") == brute(rows, 0.95)
    assert ours(spark, []) == [] and ours(spark, rows[:1]) == [(1, 0, 1, True)]
    assert ours(spark, rows, "double", 0.5) == brute(rows, 0.5)


def test_equal_to_the_threshold_and_either_side(spark):
    """cos(a, b) is 0.96 exactly: 24 / 25."""
    rows = [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [24.0, 7.0]), (4, [1.0, 0.0])]
    for least in (0.96 - 1e-9, 0.96 + 1e-9):
        assert ours(spark, rows, "double", least) == brute(rows, least)


def test_neighbouring_cells_lose_no_pair():
    """Every near pair has both vectors in one cell, or one visits the other's cell."""
    draw = np.random.default_rng(9)
    units = draw.normal(size=(400, 5))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    pivots = metric_join.Pivots.of(units[:60], 12, np.sqrt(0.1))
    found, own, between = pivots.distances(units)
    nearest = np.sqrt(found[np.arange(400), own])
    pivots.near = np.array([nearest[own == k].min(initial=np.inf) for k in range(len(pivots.points))])
    pivots.far = np.array([nearest[own == k].max(initial=-np.inf) for k in range(len(pivots.points))])
    sent = pivots.visits(found, own, between)
    a, b = np.nonzero(units @ units.T >= 0.95)
    assert len(pivots.points) == 12 and len(a) > 500 and sent.mean() < 0.3
    assert ((own[a] == own[b]) | sent[a, own[b]] ^ sent[b, own[a]]).all()
