"""Search against SQL on the documents and against plain Python on awkward rows and small trees."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import connect, differences
from fleetweave.llm import lexical_search
from fleetweave.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(rows, items, k=10):
    docs = [(i, counted(t)) for i, t in rows]
    total, n_docs = sum(sum(c.values()) for _, c in docs), sum(bool(c) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in counted(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def ours(spark, rows, items, **more):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, item_id int, score int, terms string")
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical_search.search(docs, asked, **more).collect()), key=str)


def test_the_query_against_sql(spark):
    path = "/root/testdata/sf0.001"
    assert differences(spark, connect(path), path, "op11", QUERIES["op11_lexical_search"], ORACLES["op11_lexical_search"]) == []


@pytest.mark.parametrize("page, block, item_bytes", [(128, 16_384, 1 << 20), (1, 7, 60), (3, 40, 1 << 20)])
def test_small_trees_blocks_and_passes(spark, monkeypatch, page, block, item_bytes):
    for name, value in (("PAGE", page), ("BLOCK_ROWS", block), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(lexical_search, name, value)
    draw = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(30)]
    text = lambda n: " ".join(draw.choices(words, weights, k=n))
    rows = [(k, text(draw.choice((0, 1, 3, 12, 60)))) for k in range(150)]
    rows += [(200 + k, rows[k % 3][1]) for k in range(60)]  # copies: ties of twenty and more
    items = [(k, text(draw.choice((1, 4, 9)))) for k in range(12)]
    assert ours(spark, rows, items) == brute(rows, items)


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(1, "THE cat"), (1, "the dog"), (None, "日本語 naïve"), (2, None), (3, ""), (4, "absent"), (5, "x " * 5), (6, "a\x1cb zzz 123 " + "z" * 5000)]
    assert ours(spark, rows, items) == brute(rows, items)
    assert ours(spark, rows, items, k=2) == brute(rows, items, 2)
    assert ours(spark, [], items) == [] == ours(spark, rows, [])
    assert lexical_search.search(no_rows, awkward.selectExpr("id as item_id", "text")).collect() == []


def test_bounds_hold_for_every_subtree():
    draw = np.random.default_rng(1)
    ranks = [np.sort(draw.choice(40, draw.integers(1, 12), replace=False)) for _ in range(700)]
    tfs = [draw.integers(1, 9, len(r)) for r in ranks]
    tree = lexical_search.Tree(np.arange(700), np.zeros(700, bool), draw.integers(10, 900, 700), ranks, tfs, 40)
    assert len(tree.spans) > 5
    for node, (low, high) in enumerate(tree.spans):
        own = [tree.spans[c] for c in tree.children[node]]
        assert not own or (own[0][0], own[-1][1]) == (low, high) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        bound = lexical_search.share(tree.most[node], tree.least[node])
        at = slice(tree.starts[low], tree.starts[high])
        assert (lexical_search.share(tree.tf[at], tree.m[tree.owner[at]]) <= bound[tree.rank[at]]).all()
