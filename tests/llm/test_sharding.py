"""Shards by what their law says of any assignment: every row once, gapless slots, near-equal bytes."""
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from fleetweave.llm import sharding
from fleetweave.llm.columns import range_of


def check(df, count=sharding.SHARDS):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
    found = sharding.shards(df, count).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len(t) + 8, zlib.crc32(t)) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in found} <= {("bytes", None)}
    sizes, slots = Counter(), {}
    for r in found:
        assert 0 <= r["shard"] < count
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))
    if found:
        largest, mean = max(r["size"] for r in found), sum(sizes.values()) / count
        assert all(abs(sizes[k] - mean) <= 2 * largest for k in range(count))
    return found


def test_awkward_rows(awkward):
    check(awkward)
    check(awkward, 1)


def test_no_rows(no_rows):
    assert sharding.shards(no_rows).collect() == []


def test_documents_and_repeatability(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = check(docs)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, check(docs.repartition(7))), key=str)


def test_a_third_of_all_rows_are_one_text(spark):
    draw = random.Random(6)
    rows = [(i, "the same text in very many documents" if i % 3 == 0 else "t" * draw.randrange(90)) for i in range(6000)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r["shard"] for r in found}) == sharding.SHARDS


def test_ranges_by_comparison_with_each_splitter(spark):
    draw = random.Random(2)
    for n in (0, 1, 31, 32, 33, 64, 300):
        marks = sorted({draw.randrange(-500, 500) for _ in range(n)})
        keys = spark.createDataFrame([(k,) for k in range(-520, 520)], "k long")
        got = keys.select("k", range_of(F.col("k"), marks).alias("r")).collect()
        assert all(r["r"] == sum(m <= r["k"] for m in marks) for r in got)
