"""Fingerprints and components against all pairs, on rows small enough for that."""
import random
from itertools import combinations

import xxhash

from fleetweave.llm import simhash_dedup


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over links, by repeated relabelling over all pairs."""
    nodes = sorted({p for _, p in prints})
    label = {p: p for p in nodes}
    near = [(a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 4]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    return [(i, p, least.get(label[p])) for i, p in prints]


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


def ours(df):
    return [(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()]


def same(df):
    prints = [(r["doc_id"], brute_print(r["text"])) for r in df.select("doc_id", "text").collect()]
    assert sorted(ours(df), key=key) == sorted(brute_components(prints), key=key)


def test_awkward_rows(awkward):
    same(awkward)


def test_no_rows(no_rows):
    assert ours(no_rows) == []


def test_near_copies(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(300)]
    rows = [(900 - i, " ".join(base[:i] + ["new"] + base[i:])) for i in range(0, 300, 9)] + [(5, " ".join(base[:40]))]
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_links_are_all_pairs_within_the_radius(spark):
    draw = random.Random(1)
    prints = set()
    for _ in range(20):
        centre = draw.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(7))) for _ in range(12)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed.values()], "fp long")).collect()
    pairs = [tuple(r) for r in found]
    expected = {(min(signed[a], signed[b]), max(signed[a], signed[b])) for a, b in combinations(prints, 2)
                if (a ^ b).bit_count() <= 4}
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_the_index_is_never_broadcast(spark, tmp_path):
    """It unfolds every fingerprint seventy times, so its estimated size says nothing of what the driver would hold."""
    spark.range(300).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/prints")
    found = simhash_dedup.links(spark.read.parquet(f"{tmp_path}/prints"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
