"""Rollups against counters kept change by change, and replays, compaction and the query against recounts."""
import random
from collections import Counter

import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from fleetweave.llm import token_rollups
from fleetweave.llm.byte_bpe import read_ranks
from fleetweave.llm.queries import QUERIES
from fleetweave.llm.token_rollups import Rollup

CHANGES = "source string, lang string, tokenizer_version string, op string, n_tokens long, old_tokens long, doc_id long, n_docs int"


def apply(state, rows):
    for source, lang, version, op, new, old, *_ in rows:
        docs, tokens = state.setdefault((source, lang, version), [0, 0])
        if op == "insert":
            state[source, lang, version] = [docs + 1, tokens + (new or 0)]
        elif op == "delete":
            state[source, lang, version] = [docs - 1, tokens - (old or 0)]
        elif op == "revise":
            state[source, lang, version] = [docs, tokens + (new or 0) - (old or 0)]
    return state


def found(rollup):
    return {tuple(r[:3]): list(r[3:]) for r in rollup.totals().collect()}


@pytest.fixture
def rollup(spark, tmp_path):
    return Rollup(spark, f"file://{tmp_path}/rollup")


def test_batches_replays_and_compaction(spark, rollup):
    draw, state = random.Random(1), {}
    for batch in range(5):
        rows = [(draw.choice(["a", "b", None]), draw.choice(["en", None]), draw.choice(["v1", "v2"]),
                 draw.choice(["insert", "delete", "revise", "other", None]), draw.choice([None, 5, 9]), draw.choice([None, 2]), k, 7)
                for k in range(120)]
        frame = spark.createDataFrame(rows, CHANGES)
        apply(state, rows)
        assert rollup.commit(f"day/{batch} é", frame)
        assert not rollup.commit(f"day/{batch} é", frame)
        if batch == 2:
            rollup.compact()
            assert not rollup.commit("day/0 é", frame)
        assert found(rollup) == {k: v for k, v in state.items() if v != [0, 0]}
    rollup.compact()
    assert found(rollup) == {k: v for k, v in state.items() if v != [0, 0]}


def test_empty_rollup_and_empty_batch(spark, rollup):
    assert rollup.totals().collect() == []
    assert rollup.commit("none", spark.createDataFrame([], CHANGES))
    assert rollup.totals().collect() == [] and not rollup.commit("none", spark.createDataFrame([], CHANGES))


def test_a_failed_batch_leaves_nothing(spark, rollup):
    frame = spark.createDataFrame([("a", "en", "v", "insert", 1, None, 1, 1)], CHANGES)
    with pytest.raises(Exception, match="broken"):
        rollup.commit("x", frame.selectExpr("source", "lang", "tokenizer_version", "op", "old_tokens", "raise_error('broken') as n_tokens"))
    assert rollup.totals().collect() == [] and rollup.commit("x", frame)
    assert found(rollup) == {("a", "en", "v"): [1, 1]}


def library(name):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path(name)), special_tokens={}).encode_ordinary


def test_counts_of_awkward_rows(awkward):
    encode = library("byte_bpe_50k.tiktoken")
    rows = token_rollups.counted(awkward.select("doc_id", "text"), {"v": (path("byte_bpe_50k.tiktoken"), PATTERN)}).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter(
        (r["doc_id"], len(encode(r["text"] or ""))) for r in awkward.collect())


def test_the_query_against_a_recount(spark):
    sf = "/root/testdata/sf0.001"
    rows, seen, expected = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), set(), {}
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        encode, seen = library(f"{version}.tiktoken"), set()
        for r in rows:
            if r["text"] not in seen:
                seen.add(r["text"])
                total = expected.setdefault((r["source"], r["lang"], version), [0, 0])
                total[0] += 1
                total[1] += len(encode(r["text"]))
    got = QUERIES["op3_token_rollups"](spark, sf).collect()
    assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"]] for r in got} == expected


STEPS = ["_written", "_publish", "_drop", "_tidy"]


def two(spark):
    make = lambda source: spark.createDataFrame([(source, "en", "v", "insert", 5, None, 1, 1)], CHANGES)
    return make("a"), make("b")


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("act", ["commit", "compact"])
def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, rollup, monkeypatch, act, step, after):
    a, b = two(spark)
    assert rollup.commit("1", a) and rollup.commit("2", a)
    rollup.compact()
    assert rollup.commit("3", a)
    before, with_b = {("a", "en", "v"): [3, 15]}, {("a", "en", "v"): [3, 15], ("b", "en", "v"): [1, 5]}
    plain = getattr(Rollup, step)

    def broken(self, *args):
        if after:
            plain(self, *args)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Rollup, step, broken)
        try:
            rollup.commit("4", b) if act == "commit" else rollup.compact()
        except KeyboardInterrupt:
            pass
    fresh = Rollup(spark, rollup.path)
    assert found(fresh) in ((before, with_b) if act == "commit" else (before,))
    assert all(not fresh.commit(i, b) for i in "123")
    fresh.commit("4", b)
    assert found(fresh) == with_b and not fresh.commit("4", b)
    fresh.compact()
    assert found(fresh) == with_b and all(not fresh.commit(i, b) for i in "1234")


def test_a_reader_outlives_a_compaction(spark, rollup):
    a, b = two(spark)
    rollup.commit("1", a)
    rollup.commit("2", b)
    totals = rollup.totals()
    assert rollup.compact() and not rollup.compact()
    assert totals.count() == 2


def test_writers_of_one_number_and_of_one_id(spark, rollup, monkeypatch):
    a, b = two(spark)
    other, plain = Rollup(spark, rollup.path), Rollup._written
    done = []

    def overtaken(self, rows):
        name = plain(self, rows)
        if not done:
            done.append(True)
            assert other.commit("first", a)
        return name

    monkeypatch.setattr(Rollup, "_written", overtaken)
    assert rollup.commit("second", b)  # its number was taken, so it takes the next one
    done.clear()
    assert not rollup.commit("first", b)
    monkeypatch.setattr(Rollup, "_written", lambda self, rows: overtaken(self, rows) if done else (done.append(1), other.commit("same", a), plain(self, rows))[2])
    done.clear()
    assert not rollup.commit("same", b)  # both wrote, one counted
    assert found(rollup) == {("a", "en", "v"): [2, 10], ("b", "en", "v"): [1, 5]}


def test_null_and_repeated_ids_in_the_query(spark, tmp_path):
    rows = [(1, "x y", "s", "en", 3), (1, "x y", "s", "en", 3), (None, "x y", "s", "en", 3), (None, "other", "s", "en", 5), (None, None, "s", None, None), (2, "", "s", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["lang"], r["tokenizer_version"]): r["n_docs"] for r in QUERIES["op3_token_rollups"](spark, str(tmp_path)).collect()}
    assert got == {(lang, v): n for v in ("byte_bpe_50k", "byte_bpe_multi_50k") for lang, n in (("en", 2), (None, 1))}
