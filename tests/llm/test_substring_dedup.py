"""Removed words against a brute-force reading of the definition."""
import random
import time

import numpy as np

from fleetweave.llm import substring_dedup
from fleetweave.llm.substring_dedup import COVER, PERIOD, WINDOW


def brute(rows):
    """Definition: each 13-word passage, looked up among those that start in documents with smaller ids."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    rank = {i: (i is None, i or 0) for i, _ in rows}
    for i, words in split:
        for k in range(len(words) - WINDOW + 1):
            passage = tuple(words[k:k + WINDOW])
            least[passage] = min(least.get(passage, rank[i]), rank[i])
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if least[tuple(words[k:k + WINDOW])] < rank[i]:
                gone.update(range(k, k + WINDOW))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def ours(df):
    found = substring_dedup.without_repeats(df).collect()
    assert all(sum(s["words"] for s in r["removed"]) == r["n_removed"] for r in found)
    return [(r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found]


def key(row):
    return (row[0] is None, row[0] or 0, row[3])


def same(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(ours(df), key=key) == sorted(brute(rows), key=key)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_awkward_rows(awkward):
    same(awkward)


def test_no_rows(no_rows):
    assert ours(no_rows) == []


def test_documents(spark):
    same(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_shared_passages_at_all_offsets(spark):
    """Passages of 11 to 40 words pasted anywhere, over several partitions."""
    draw = random.Random(5)
    passages = [[f"p{k}w{j}" for j in range(n)] for k, n in enumerate((11, 12, 13, 14, 20, 40))]
    rows = []
    for i in range(150):
        words = [f"u{i}x{j}" for j in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = draw.choice(passages)
        rows.append((draw.randrange(120), " ".join(words)))
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_answers_cost_what_their_blocks_hold():
    """Many small blocks that share all anchors: a block's answer must not cost what all blocks share."""
    draw = np.random.default_rng(2)
    anchors = np.sort(draw.integers(0, 1 << 63, 100_000).astype(np.uint64))
    blocks = [anchors[k % 1000::1000] for k in range(2000)] + [np.array([7], np.uint64), np.empty(0, np.uint64)]
    began = time.process_time()
    answers = substring_dedup._answer_anchors([substring_dedup._steps(b) for b in blocks])
    assert time.process_time() - began < 4
    shared = substring_dedup._bits(dict(enumerate(answers)), np.array([len(b) for b in blocks]))
    assert shared.tolist() == [True] * 200_000 + [False]
