"""Chunked scans equal plain windows, however the chunks fall."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetweave.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 300), ("warm", 40), ("one", 1)):
        for i in sorted(rng.sample(range(1000), n)):
            data.append((key, i, rng.choice([None, 1.5, 2.5, -3.0])))
    return spark.createDataFrame(data, "k string, pos long, v double").cache()


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_running_equals_window(rows, width):
    got = scan.running(rows, ["k"], ["pos"], scan.by_number("pos", width), prev={"p": "v"}, last={"l": "v"},
                       before={"b": "v"}, first={"f": "v"}, total={"t": "v"}, peak={"m": "v"})
    w = Window.partitionBy("k").orderBy("pos")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("k", "pos", "v", F.lag("v").over(w).alias("p"), F.last("v", True).over(upto).alias("l"),
                       F.last("v", True).over(earlier).alias("b"), F.first("v").over(upto).alias("f"),
                       F.sum("v").over(upto).alias("t"), F.max("v").over(upto).alias("m"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_following_is_lead(spark, at):
    data = [("a", at(s), i) for i, s in enumerate([0, 10, 10, 5000, 9000])]
    df = spark.createDataFrame(data, "k string, ts timestamp, id long")
    got = {r.id: r.n for r in scan.following(df, ["k"], "ts", "id", 3600, "n", "id").collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: None}


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_trailing_rows(rows, chunk):
    placed = scan.running(rows, ["k"], ["pos"], scan.by_number("pos"), total={"n": F.lit(1).cast("long")})
    got = scan.trailing_rows(placed, ["k"], "n", 4, {"s": F.sum("pos"), "c": F.count("*")}, chunk)
    w = Window.partitionBy("k").orderBy("n").rowsBetween(-3, 0)
    want = placed.withColumns({"s": F.sum("pos").over(w), "c": F.count("*").over(w)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_ranked_numbers_every_key(rows):
    got = scan.ranked(rows, ["k"], [-F.col("pos")], "rank")
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("pos"))))
    assert sorted(map(tuple, got.select("k", "pos", "rank").collect())) == sorted(map(tuple, want.select("k", "pos", "rank").collect()))


def test_ranked_without_keys(rows):
    got = [r.rank for r in scan.ranked(rows, [], ["k", "pos"], "rank").orderBy("k", "pos").collect()]
    assert got == list(range(1, 342))


def test_blocks_cover_a_span_once_and_are_few(spark):
    spans = [(a, a + n) for a in (-70, -1, 0, 7, 63, 511, 12345) for n in (0, 1, 6, 7, 8, 15, 63, 64, 500, 4095, 4096)]
    spans += [(0, 3_900_000), (17, 8 ** 9 + 5), (-(8 ** 12), 8 ** 12)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", scan.cover(F.col("a"), F.col("b")).alias("blocks")).collect()
    for r in rows:
        parts = sorted((n << 3 * level, (n + 1) << 3 * level) for level, n in r.blocks)
        assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 14 * (1 + max(level for level, _ in r.blocks))
        top = spark.range(1).select(scan.levels(F.lit((r.b - r.a) * 10 + 1), 10)).first()[0]
        assert max(level for level, _ in r.blocks) <= max(top, 1)
    assert len(next(r for r in rows if r.b == 3_900_000).blocks) < 60


def test_an_event_finds_its_bucket_in_one_block(spark):
    a, b = 1234, 1234 + 70_000
    blocks = {tuple(x) for x in spark.range(1).select(scan.cover(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]}
    asked = spark.createDataFrame([(a - 1,), (a,), (a + 1,), (20_000,), (b,), (b + 1,)], "bucket long")
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(6)))).select("bucket", "level", scan.block_of(F.col("bucket"), F.col("level")).alias("n"))
    found = {}
    for r in asked.collect():
        found[r.bucket] = found.get(r.bucket, 0) + ((r.level, r.n) in blocks)
    assert found == {a - 1: 0, a: 1, a + 1: 1, 20_000: 1, b: 1, b + 1: 0}
