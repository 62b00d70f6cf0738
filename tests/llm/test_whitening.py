"""Whitening against plain numpy and exact integers."""
import math

import numpy as np
import pytest

from fleetweave.llm import whitening
from fleetweave.llm.queries import QUERIES


def brute(rows, components=8):
    """{(row, component): (id, deviation, whitened up to its sign, explained)} of rows (id, vector) of one length."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[c - s / n for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for r, (row, (i, _)) in enumerate(zip(x, rows)):
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        for k in range(min(components, len(sums))):
            e, axis = values[-1 - k], axes[:, -1 - k]
            out[r, k + 1] = i, deviation, centred[r] @ axis / math.sqrt(e), e / values.sum()
    return out


def check(found, rows, components=8, error=1e-9):
    """Rows must have distinct ids."""
    expected = brute(rows, components)
    assert len(found) == len(expected)
    at = {i: r for r, (i, _) in enumerate(rows)}
    signs = {}
    for f in found:
        i, deviation, value, explained = expected[at[f["id"]], f["component"]]
        assert (f["id"], f["deviation"], f["n"]) == (i, deviation, len(rows))
        assert f["explained"] == pytest.approx(explained, rel=1e-9) and 0 <= f["identity_error"] < error
        if abs(value) > 1e-6:
            sign = signs.setdefault(f["component"], math.copysign(1, value * f["whitened"]))
            assert f["whitened"] == pytest.approx(sign * value, rel=1e-6, abs=1e-8)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 5, "x", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, index int, part string, x int")


def test_the_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check([r.asDict() | {"id": r["vec_id"]} for r in QUERIES["op13_whitening"](spark, path).collect()], rows)


def test_many_blocks_and_splits(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    draw = np.random.default_rng(4)
    mixed = draw.normal(size=(300, 5)) @ draw.normal(size=(5, 5)) * [9, 1, 1, 4, 0.3] + 50
    rows = [(3 * k, v.tolist()) for k, v in enumerate(mixed)]
    check(whitening.whitened(frame(spark, rows).repartition(7)).collect(), rows)
    check(whitening.whitened(frame(spark, rows), components=2).collect(), rows, 2)


def test_rows_that_go(spark):
    draw = np.random.default_rng(8)
    good = [(k, draw.normal(size=3).tolist()) for k in range(20)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]),
           (106, [1e300, 0.0, 0.0]), (107, [1.0, 2.0, 3.0, 4.0])]
    check(whitening.whitened(frame(spark, bad[:4] + good + bad[4:])).collect(), good)
    assert whitening.whitened(frame(spark, bad[:3])).collect() == []
    assert whitening.whitened(frame(spark, [])).collect() == []


def test_repeated_rows_null_ids_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [4.0, 2.0])]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert len(found) == 8 and {f["component"] for f in found} == {1, 2}
    first = sorted(abs(f["whitened"]) for f in found if f["component"] == 1)
    assert first == pytest.approx([1 / math.sqrt(3)] * 3 + [math.sqrt(3)])
    assert all(f["whitened"] == f["explained"] == 0 for f in found if f["component"] == 2)
    assert all(f["identity_error"] < 1e-9 for f in found)
    for few in (rows[:1], rows[:3]):
        found = whitening.whitened(frame(spark, few)).collect()
        assert [(f["whitened"], f["explained"], f["identity_error"], f["deviation"]) for f in found] == [(0, 0, 0, 0)] * (2 * len(few))


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(k, [6e10 * (-1) ** k, float(k)]) for k in range(4)]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert len(found) == 8 and all(f["deviation"] is None for f in found)
