"""Scores against dictionaries of counts and a traversal written out word by word."""
import math
import zlib
from collections import Counter

import pytest

from fleetweave.llm import lm_scoring
from fleetweave.llm.lm_scoring import STRENGTH

END, START = "</s>", "<s>"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def trained(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def brute(rows):
    single, double, context = Counter(), Counter(), Counter()
    for i, text in rows:
        if trained(i):
            words = tokens(text)
            single.update(words)
            context.update([START, *words[:-1]])
            double.update(zip([START, *words[:-1]], words))
    total, distinct = sum(single.values()), len(single)
    floor = total + 0.1 * (distinct + 1)
    out = []
    for i, text in rows:
        words, base, score, known, before = tokens(text), 0.0, 0.0, 0, START
        for w in words:
            p = (single[w] + 0.1) / floor
            base += math.log10(p)
            known += single[w] > 0
            score += math.log10((double[before, w] + STRENGTH * p) / (context[before] + STRENGTH)) if context[before] else math.log10(p)
            before = w
        out.append((i, not trained(i), len(words), known, total, round(base, 6), round(score, 6)))
    return out


def ours(df):
    return [(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
             round(r["score"], 6)) for r in lm_scoring.scores(df).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[2])


def same(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for a, b in zip(sorted(ours(df), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6, rel=1e-9)


def test_awkward_rows(awkward):
    same(awkward)


def test_documents(spark):
    same(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_no_rows(no_rows):
    assert ours(no_rows) == []


def test_nothing_to_learn_from(spark):
    rows = [(i, f"word {i}") for i in range(80) if not trained(i)]
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_the_model_beats_the_base_on_held_out_documents(spark):
    rows = lm_scoring.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
