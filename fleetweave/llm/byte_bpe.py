"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table.

Texts are cut into words and every distinct word of a block of documents once into pre-tokens. Each block names its
distinct pre-tokens once, and every distinct pre-token of the corpus is encoded once, in the slice where all blocks that
hold it meet. Its ids return to these blocks, where the pre-tokens stand at their positions. Merges follow the ranks of
the vocabulary file; nothing is trained here.
"""
from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm import blocks
from fleetweave.llm.blocks import Block
from fleetweave.llm.scratch import shuffle_width
from fleetweave.llm.text import packed, release, unpacked

DECODED_ROWS = 250  # decoded together
# The pattern whose texts are cut into words first; a text under any other pattern is one word.
WORDED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED = "id long, token_ids array<int>"
_ENCODED = pa.schema([("id", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FILLED = ~_SPACE  # bytes that begin no white space; beyond ASCII, some of it begins with one of these four
_FILLED[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers. Its size is the vocabulary's, so bounded."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the neighbours of lowest rank, leftmost first, until no pair has a rank.

    Pairs wait in a heap and parts are a linked list, so a pre-token of n bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # a part is piece[start:ends[start]]; 0 once it has been joined to the left
    before = list(range(-1, n - 1))
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, end = heapq.heappop(waiting)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i:ends[end]])) is not None:
                heapq.heappush(waiting, (rank, i, ends[end]))
        left = before[i]
        if left >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heapq.heappush(waiting, (rank, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


@lru_cache(maxsize=4)
def disputed(pattern: str) -> dict[int, str]:
    """Characters that the two regular-expression libraries class differently, with a stand-in that both class alike.

    The libraries know different versions of Unicode, and ``str.isalpha`` a third. The public encoder decides, so its view
    of every code point is read off once, on the driver.
    """
    kinds = sorted(set(regex.findall(r"\\p\{\w+\}|\\s", pattern)))
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    theirs, ours = [], []
    for kind in kinds:
        encoder = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs.append(frozenset(bytes(encoder.encode_ordinary(every)).decode()))
        ours.append(frozenset(regex.findall(kind, every)))
    odd = frozenset().union(*(a ^ b for a, b in zip(theirs, ours)))
    if r"\p{L}" in kinds:
        odd |= theirs[kinds.index(r"\p{L}")] ^ frozenset(filter(str.isalpha, every))
    stand_ins = {tuple(c in k for k in ours): c for c in "a1!\t"}
    return {ord(c): stand_ins[tuple(c in k for k in theirs)] for c in odd}


def cutter(pattern: str, odd: dict[int, str]):
    """A function that cuts a text into its pre-tokens."""
    find, span, strange = regex.compile(pattern).findall, regex.compile(pattern).finditer, frozenset(map(chr, odd))
    plain = min(odd, default=0x110000) > 255

    def cut(text: str) -> list[str]:
        if not (plain and _latin(text)) and not strange.isdisjoint(text):
            return [text[m.start():m.end()] for m in span(text.translate(odd))]
        return find(text)

    return cut if odd else find


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Numbered(dict):
    """Numbers keys in the order they first come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def words_of(texts: list[bytes], pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All texts as numbers of words, the place of each text's first word (and the end), and the distinct words.

    A word's pre-tokens do not depend on what stands around it, and the words joined are the texts. Under ``WORDED`` the
    last white space before other characters always begins a pre-token, and unless it is a blank it is one by itself: words
    begin at both borders.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    borders = np.cumsum([0, *map(len, texts)])
    begins = np.zeros(len(data) + 1, bool)
    if pattern == WORDED and len(data):
        last = _SPACE[data[:-1]] & _FILLED[data[1:]]
        inner = borders[(borders > 0) & (borders < len(data))]
        last[inner - 1] = False  # what follows is another text
        begins[:-2] = last
        begins[1:-1] |= last & (data[:-1] != 32)
    begins[borders] = True
    edges = np.flatnonzero(begins)
    buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
    words = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, buffers).dictionary_encode()
    return words.indices.to_numpy(), np.searchsorted(edges, borders), words.dictionary.to_numpy(zero_copy_only=False).tolist()


@dataclass
class _Cut:
    """A block's texts as numbers of words, its distinct words as numbers of pre-tokens, its distinct pre-tokens."""

    words: np.ndarray
    firsts: np.ndarray  # place of each text's first word, and the number of words at the end
    inside: np.ndarray  # pre-tokens of the distinct words, one word after the other
    sizes: np.ndarray  # number of pre-tokens of each distinct word
    pieces: list[bytes]


def _distinct(block: Block, pattern: str, odd: dict[int, str]) -> _Cut:
    words, firsts, distinct = words_of(block.texts, pattern)
    seen = set("".join(distinct))
    odd = {c: stand_in for c, stand_in in odd.items() if chr(c) in seen}
    numbers, cut, sizes = _Numbered(), cutter(pattern, odd), []
    simple = pattern == WORDED and not odd  # letters alone, with a blank before them or not, are one pre-token

    def pieces():
        for word in distinct:
            if simple and (word[1:] if word[0] == " " else word).isalpha():
                sizes.append(1)
                yield word
                continue
            found = cut(word)
            sizes.append(len(found))
            yield from found

    inside = np.fromiter(map(numbers.__getitem__, pieces()), np.int32)
    return _Cut(words, firsts, inside, np.array(sizes, np.int64), [piece.encode() for piece in numbers])


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, row: np.ndarray, step: int = 1 << 18):
    """The stretches of ``flat`` that a row of numbers names, in its order, some at a time so that little is held wide."""
    for k in range(0, len(row), step):
        part = row[k:k + step]
        lengths = sizes[part]
        upto = np.cumsum(lengths)
        yield flat[np.repeat(starts[part] - upto + lengths, lengths) + np.arange(int(upto[-1]))]


def _sums(sizes: np.ndarray) -> np.ndarray:
    """Zero and the running totals."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _slices(pieces: list[bytes], width: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p) % width for p in pieces), np.int64, len(pieces))


def _ask(pattern: str, odd: dict[int, str], width: int):
    def question(block: Block) -> dict[int, bytes]:
        pieces = _distinct(block, pattern, odd).pieces
        where = _slices(pieces, width)
        out = {}
        for k in np.unique(where).tolist():
            mine = [pieces[i] for i in np.flatnonzero(where == k).tolist()]
            sizes = np.array([len(p) for p in mine], np.uint32)
            out[k] = np.int64(len(mine)).tobytes() + packed(sizes) + b"".join(mine)
        return out
    return question


def _answer(ranks):
    def answer(bodies: list[bytes]) -> list[bytes]:
        table, known, out = ranks.value, {}, []
        for body in bodies:
            n = int(np.frombuffer(body, np.int64, 1)[0])
            ends = np.cumsum(unpacked(body[8:8 + 4 * n], np.uint32), dtype=np.int64) + 8 + 4 * n
            found, start = [], 8 + 4 * n
            for end in ends.tolist():
                piece = body[start:end]
                ids = known.get(piece)
                if ids is None:
                    known[piece] = ids = merge(piece, table)
                found.append(ids)
                start = end
            sizes = np.array([len(i) for i in found], np.uint32)
            out.append(np.int64(n).tobytes() + packed(sizes)
                       + packed(np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))))
        return out
    return answer


def _assemble(pattern: str, odd: dict[int, str], width: int):
    def settle(block: Block, answers: dict[int, bytes]) -> pa.Table:
        made = _distinct(block, pattern, odd)
        where = _slices(made.pieces, width)
        sizes, parts = np.zeros(len(made.pieces), np.int64), {}
        for k, body in answers.items():
            n = int(np.frombuffer(body, np.int64, 1)[0])
            sizes[where == k] = unpacked(body[8:8 + 4 * n], np.uint32)
            parts[k] = unpacked(body[8 + 4 * n:], np.uint32)
        starts = _sums(sizes)
        flat = np.empty(int(starts[-1]), np.int32)
        for k, ids in parts.items():
            mine = np.flatnonzero(where == k)
            own = np.repeat(starts[mine] - _sums(sizes[mine])[:-1], sizes[mine])
            flat[own + np.arange(len(ids))] = ids
        none = np.empty(0, np.int32)
        borders = _sums(sizes[made.inside])[_sums(made.sizes)]  # of each distinct word's tokens
        inside = np.concatenate([none, *_spread(flat, starts, sizes, made.inside)])
        lengths = np.diff(borders)
        tokens = np.concatenate([none, *_spread(inside, borders, lengths, made.words)])
        offsets = _sums(lengths[made.words])[made.firsts]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))
        return pa.Table.from_arrays([pa.array(block.ids, mask=block.nulls), lists], schema=_ENCODED)
    return settle


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, token_ids), the ids of the whole text without special tokens.

    ``path`` names a file of ranks, ``pattern`` cuts texts into pre-tokens, each encoded separately. Null and empty texts
    give an empty list. Repeated rows stay repeated, null ids stay null, other columns are not read.
    """
    width, odd = shuffle_width(docs), disputed(pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    answers = blocks.answered(blocks.ask(docs, "id", "text", _ask(pattern, odd, width)), _answer(ranks))
    return blocks.settled(docs, "id", "text", answers, _assemble(pattern, odd, width), ENCODED)


class _TokenTable:
    """Token bytes by id, one after the other in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.full(max(ranks.values()) + 1, -1, np.int64)  # -1: no such id
        tokens = [b""] * len(self.sizes)
        for token, rank in ranks.items():
            tokens[rank], self.sizes[rank] = token, len(token)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)

    def sizes_of(self, ids: np.ndarray) -> np.ndarray:
        known = (ids >= 0) & (ids < len(self.sizes))
        return np.where(known, self.sizes[np.where(known, ids, 0)], -1)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of known ids."""
        return b"".join(part.tobytes() for part in _spread(self.data, self.starts, self.sizes, ids))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", name: str = "data") -> DataFrame:
    """Add ``name``, the bytes of each id list: ids meet the token-byte table, sent to every task as it is bounded.

    A null list, or one with a null or an id that the table lacks, gives null.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    table = encoded.sparkSession.sparkContext.broadcast(_TokenTable(read_ranks(path)))
    place = encoded.columns.index(ids_col)
    schema = StructType([*[f for f in encoded.schema if f.name != name], StructField(name, BinaryType())])
    kept = [i for i, c in enumerate(encoded.columns) if c != name]

    def data_of(column: pa.ListArray) -> pa.Array:
        """Bytes of the rows whose ids are all known."""
        flat = column.flatten()
        ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        sizes = table.value.sizes_of(ids)
        upto = np.concatenate(([0], np.cumsum(sizes < 0)))
        ends = np.cumsum(counts)
        bad = upto[ends] > upto[ends - counts]
        good = np.repeat(~bad, counts)
        data = table.value.bytes_of(ids[good])
        lengths = np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))
        offsets = np.concatenate(([0], lengths[ends])).astype(np.int32)
        missing = bad | column.is_null().to_numpy(zero_copy_only=False)
        valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], data_of(part.column(place))],
                                                 names=[*[part.schema.names[i] for i in kept], name])
            release()

    return encoded.mapInArrow(run, schema)
