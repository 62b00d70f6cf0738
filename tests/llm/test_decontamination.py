"""Leaks against every window of every item's size, and the fingerprint against its definition."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetweave.llm import decontamination


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[k:k + 5]) for k in range(len(words) - 4)]


def brute_leaks(docs, items):
    """Best window of each (document, item) with weighted Jaccard similarity of 0.8 or more."""
    out = []
    grams = [(j, shingles(t)) for j, t in items]
    known = {s for _, g in grams for s in g}
    for i, text in docs:
        own = shingles(text)
        if not known.intersection(own):
            continue
        for j, mine in grams:
            n, best = len(mine), None
            if not n or not set(mine).intersection(own):
                continue
            counts, w = Counter(mine), min(n, len(own))  # a shorter document is one window as a whole
            for s in range(len(own) - w + 1):
                common = sum((counts & Counter(own[s:s + w])).values())
                similarity = common / (w + n - common)
                if similarity >= 0.8 and (best is None or similarity > best[1]):
                    best = (s, similarity)
            if best:
                out.append((i, j, best[0], w + 4, round(best[1], 9)))
    return out


def ours(docs, benchmark):
    return [(r["id"], r["item_id"], r["start"], r["n_words"], round(r["similarity"], 9))
            for r in decontamination.contaminated(docs, benchmark).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_documents(spark):
    path = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    expected = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert expected and sorted(ours(docs, items)) == sorted(expected)


def test_edited_leaks_repeats_and_awkward_rows(spark):
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(4000)}"
    items = [(j, " ".join(word() for _ in range(draw.choice((20, 33, 60))))) for j in range(12)]
    items += [(20, "echo " * 30), (21, "a b a b a b a b a b a b a b a b a b"), (22, "too short"), (23, None), (24, ""), (25, items[0][1])]
    docs = [(None, "before " + items[3][1]), (1, None), (2, ""), (3, "x " * 5000 + items[4][1]), (4, "echo " * 29), (5, "b " + "a b " * 9)]
    for i in range(10, 40):
        words = items[draw.randrange(12)][1].split()
        if i % 2 and len(words) == 60:
            words[draw.randrange(1, 59)] = "edited"
        docs.append((i, " ".join([word() for _ in range(draw.randrange(40))] + words + [word() for _ in range(9)]).upper()))
    docs.append(docs[-1])
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, block int, value int")
    bench = spark.createDataFrame([(j, t, 0) for j, t in items], "item_id long, text string, _n int")
    assert sorted(ours(frame, bench), key=key) == sorted(set(brute_leaks(docs, items)), key=key)
    assert ours(frame.where("false"), bench) == ours(frame, bench.where("false")) == []


def test_simhash_by_definition(spark):
    draw = random.Random(4)
    rows = [[draw.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 36)]
    rows.append(rows[2] + rows[2][:2])
    found = spark.createDataFrame([(r,) for r in rows], "h array<long>").select("h", decontamination.simhash(F.col("h")).alias("p"))
    for r in found.collect():
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"]))
        assert r["p"] % (1 << 64) == bits


@pytest.mark.parametrize("bits", [0, 1, 8, 15])
def test_every_pair_within_the_radius_shares_a_block_variant(bits):
    draw = random.Random(bits)
    for _ in range(300):
        x = sum(1 << b for b in draw.sample(range(64), bits))
        assert min((x >> 16 * k & 0xFFFF).bit_count() for k in range(4)) <= decontamination.RADIUS // decontamination.BLOCKS
