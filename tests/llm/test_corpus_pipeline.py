"""The pipeline against its definition in plain Python, given which documents the language stage accepts."""
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline
from fleetweave.llm import byte_bpe, line_dedup
from test_decontamination import brute_leaks
from test_line_dedup import brute as brute_lines
from test_similar_texts import brute_kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_against_brute_force(spark, documents):
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in corpus_pipeline.language(spark, documents, SF).collect()}
    assert len(texts) == documents.count()  # clean documents stay
    cleaned = {i: t for i, t, _, _ in brute_lines([(i, *v) for i, v in texts.items()], line_dedup.MIN_SITES)}
    kept = {i: cleaned[i] for i in brute_kept(sorted(cleaned.items()))}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    leaked = {i for i, *_ in brute_leaks(list(kept.items()), [(r["item_id"], r["text"]) for r in items])}
    library = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.read_ranks(path(corpus_pipeline.VOCABULARY)))
    expected = {i: (library.encode_ordinary(t), t) for i, t in kept.items() if i not in leaked}
    found = corpus_pipeline.run(spark, SF).collect()
    assert len(found) == len(expected) < len(texts) and leaked
    assert {r["doc_id"]: (list(r["token_ids"]), r["text"]) for r in found} == expected
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows_and_no_rows(spark, name, stage):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "some words here", None, "a", 15),
            (None, "some words here", None, "a", 15), (3, "some words here", "en", "b", 15), (4, "12 | 34", "en", "b", 7),
            (5, "der die das und über " * 4000, "de", "c", 84000), (5, "der die das und über " * 4000, "de", "c", 84000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, SF)
    if name != "byte-level bpe":
        assert out.columns == COLUMNS
    found = [r["doc_id"] for r in out.collect()]
    if name == "language id":
        assert sorted(found, key=str) == sorted([None, None, 3, 5, 5], key=str)
    elif name == "simhash near-dedup":
        assert sorted(found) == [1, 3, 4, 5] and len(out.collect()) == 4
    else:
        assert len(found) == len(rows)
    assert stage(spark, docs.where("false"), SF).collect() == []
