"""Encoding against the public library on the same ranks, and the exact round trip."""
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from fleetweave.llm import byte_bpe
from fleetweave.llm.blocks import Block

FILE = path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(FILE)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def both(df):
    encoded = byte_bpe.decode(byte_bpe.encode(df, FILE, PATTERN), FILE)
    return [(r["id"], list(r["token_ids"]), bytes(r["data"])) for r in encoded.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[2])


def test_awkward_rows_as_the_library(awkward, library):
    expected = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode())
                for r in awkward.select("doc_id", "text").collect()]
    assert sorted(both(awkward), key=key) == sorted(expected, key=key)


def test_no_rows(no_rows):
    assert both(no_rows) == []


def test_documents_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = [(r["doc_id"], library.encode_ordinary(r["text"]), r["text"].encode()) for r in docs.collect()]
    assert sorted(both(docs), key=key) == sorted(expected, key=key)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab c'st\né", max_size=200))
def test_pieces_and_merges_as_the_library(library, text):
    pieces = byte_bpe.cutter(PATTERN, byte_bpe.disputed(PATTERN))(text)
    assert [i for p in pieces for i in byte_bpe.merge(p.encode(), RANKS)] == library.encode_ordinary(text)


def test_long_pieces(library):
    ranks = RANKS
    for piece in ("a" * 3000, "ab" * 1500, "é" * 999, "-=" * 700):
        assert byte_bpe.merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_every_code_point_is_cut_as_the_library_does(library):
    """The two libraries know different versions of Unicode; each code point must still join the same pre-tokens."""
    ranks, cut = RANKS, byte_bpe.cutter(PATTERN, byte_bpe.disputed(PATTERN))
    for start in range(0, 0x110000, 997):
        text = "".join(f"{chr(c)}a {chr(c)}1'{chr(c)}" for c in range(start, min(start + 997, 0x110000))
                       if not 0xD800 <= c < 0xE000)
        assert [i for p in cut(text) for i in byte_bpe.merge(p.encode(), ranks)] == library.encode_ordinary(text)


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [5]), (2, [99999999]), (3, None), (4, [])], "data long, ids array<int>")
    out = {i: r for i, r in enumerate(byte_bpe.decode(rows, FILE, "ids", "plain").orderBy("data").collect())}
    assert [r["plain"] is None for r in out.values()] == [False, True, True, False]


ODD = byte_bpe.disputed(PATTERN)
SPACES = "\t\n\v\f\r \x1c\x1f\x85\xa0\u1680\u2003\u200b\u2028\u202f\u205f\u3000"


def pieces_of(texts, pattern=PATTERN):
    """The pre-tokens of each text of a block."""
    block = Block(0, np.arange(len(texts)), np.zeros(len(texts), bool), [t.encode() for t in texts], 0)
    made = byte_bpe._distinct(block, pattern, ODD)
    ends = np.cumsum(made.sizes)
    of_word = [[made.pieces[i].decode() for i in made.inside[e - n:e]] for e, n in zip(ends, made.sizes)]
    return [[p for w in made.words[a:b] for p in of_word[w]] for a, b in zip(made.firsts, made.firsts[1:])]


def test_a_block_cuts_each_distinct_word_once(monkeypatch):
    """Few words fill many texts: what is cut into pre-tokens follows the words, not the texts."""
    seen, cutter = [], byte_bpe.cutter

    def counting(*args):
        cut = cutter(*args)
        return lambda text: seen.append(len(text)) or cut(text)

    monkeypatch.setattr(byte_bpe, "cutter", counting)
    texts = [f"It's a one-word, two-word test.\nOver {i % 10} and over; " for i in range(2000)]
    block = Block(0, np.arange(2000), np.zeros(2000, bool), [t.encode() for t in texts], 0)
    byte_bpe._ask(PATTERN, ODD, 4)(block)
    assert sum(seen) < 200


def test_the_pattern_of_words_is_the_public_one():
    assert byte_bpe.WORDED == PATTERN


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=SPACES + "ab'st1.\u00e9\u00ab\u201c\u1ebf\u3042\U0001f600\u0301", max_size=24), max_size=6))
def test_words_keep_the_pre_tokens_at_any_white_space(library, texts):
    whole = byte_bpe.cutter(PATTERN, ODD)
    assert pieces_of(texts) == [whole(t) for t in texts]
    for text, pieces in zip(texts, pieces_of(texts)):
        assert [i for p in pieces for i in byte_bpe.merge(p.encode(), RANKS)] == library.encode_ordinary(text)


def test_words_of_every_code_point_keep_the_pre_tokens():
    whole = byte_bpe.cutter(PATTERN, ODD)
    for start in range(0, 0x110000, 9973):
        some = [chr(c) for c in range(start, min(start + 9973, 0x110000)) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"{c}  {c}\n{c}" for c in some), " ".join(some)]
        assert pieces_of(texts) == [whole(t) for t in texts]


def test_another_pattern_cuts_whole_texts():
    assert pieces_of(["ab  cd ab", "", "x"], r"\w\w|\s+|\w") == [["ab", "  ", "cd", " ", "ab"], [], ["x"]]
