"""Components of chains, stars, dense groups and random graphs against a plain search."""
import random

import pytest

from fleetweave.llm import linking


def brute(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in label:
                label[node] = start
                todo += near[node]
    return label


def random_pairs():
    draw = random.Random(2)
    return [tuple(draw.sample(range(-200, 200), 2)) for _ in range(180)]


@pytest.mark.parametrize("pairs", [
    [], [(1, 2)], [(k, k + 1) for k in range(90)], [(0, k) for k in range(1, 50)], [(k, 100 - k) for k in range(50)],
    [(a, b) for a in range(25) for b in range(a + 1, 25)], random_pairs()],
    ids=["none", "one", "chain", "star", "matching", "dense", "random"])
def test_components(spark, pairs):
    rows = linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    expected = brute(pairs)
    assert sorted(r["node"] for r in rows) == sorted(expected)
    roots = {r["node"]: r["root"] for r in rows}
    names = {(expected[n], roots[n]) for n in roots}
    assert len(names) == len(set(expected.values())) == len(set(roots.values()))


def test_a_forest_keeps_the_components_and_few_pairs(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    kept = [tuple(r) for r in linking.forest(spark.createDataFrame(pairs, "a long, b long").coalesce(1)).collect()]
    assert len(kept) == 39 and set(brute(kept).values()) == {0}
