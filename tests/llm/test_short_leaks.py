"""Documents shorter than the item that they hold nearly all of."""
import corpus_pipeline
from fleetweave.llm import decontamination
from fleetweave.llm.queries import QUERIES
from test_decontamination import brute_leaks


def rows(spark):
    words = [f"w{k}" for k in range(60)]
    items = [(0, " ".join(words)), (1, "echo " * 30), (2, " ".join(f"v{k}" for k in range(40)))]
    docs = [(k, " ".join(words[:k])) for k in (1, 40, 48, 49, 50, 59, 60)] + [(100, "echo " * 29), (101, " ".join(words[3:])), (102, None)]
    docs += [(200, " ".join(f"v{k}" for k in range(1, 40))), (201, "some clean text of a few more words than five")]
    return docs, items


def test_short_documents_are_compared_whole(spark):
    docs, items = rows(spark)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(frame, bench).collect()
    expected = brute_leaks(docs, items)
    assert len(expected) >= 6
    assert sorted((r["id"], r["item_id"], r["start"], r["n_words"], round(r["similarity"], 9)) for r in found) == sorted(expected)


def test_the_query_and_the_stage_report_them(spark, tmp_path):
    docs, items = rows(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = {r["doc_id"] for r in QUERIES["op6_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert {59, 60, 100, 101, 200} <= leaked and not leaked & {1, 40, 102, 201}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, frame, str(tmp_path)).collect()} == {i for i, _ in docs} - leaked


def test_clean_rows_keep_their_place_beside_leaks_of_the_same_id(spark, tmp_path):
    leak = " ".join(f"w{k}" for k in range(30))
    rows = [(1, leak), (1, "a clean text of the same id and more"), (None, leak), (None, "another clean text without any id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [tuple(r) for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != leak], key=str)
