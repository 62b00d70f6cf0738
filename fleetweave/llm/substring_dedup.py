"""Substring dedup by difference-cover anchors: remove words of passages that an earlier document also has.

A passage is ``WINDOW`` consecutive words. Anchors are shorter windows hashed only at positions whose remainder modulo
``PERIOD`` is in ``COVER``. Every difference of two remainders occurs in the cover, so two equal passages, wherever they
stand, have an anchor at the same offset; ``WINDOW = ANCHOR + PERIOD - 1`` keeps it inside. Anchors that occur in one
document only therefore rule out every passage around them. The others are extended to all passages that hold them, and
equal passages learn the smallest document they start in. Anchors merely filter; passages are told apart by 128 bits.
"""
from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm import blocks
from fleetweave.llm.blocks import NOTES, Block
from fleetweave.llm.scratch import shuffle_width
from fleetweave.llm.text import Words, packed, span_hashes, unpacked, windows, words_of

WINDOW, ANCHOR, PERIOD = 13, 7, 7
COVER = (0, 1, 3)
LAST = np.iinfo(np.int64).max  # where null ids stand
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPANS),
                     ("kept_text", pa.string())])
RESULT = "id long, n_words long, n_removed long, removed array<struct<start: long, words: long>>, kept_text string"


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys, the last one deciding first, and where each run of equal keys starts in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _spread(order: np.ndarray, firsts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Give every row the value of its group."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(firsts, len(order))))
    return out


def _steps(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def _values(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


class _Anchors:
    """The anchors of a block: positions, distinct hashes and which of these two documents of the block share."""

    def __init__(self, texts: list[bytes]):
        self.words: Words = words_of(texts)
        self.hashes = self.words.hashes()
        at, marks = windows(self.hashes, self.words.firsts, ANCHOR)
        owner = self.words.owner[at]
        place = at - self.words.firsts[owner]
        used = np.isin(place % PERIOD, COVER) & (self.words.counts[owner] >= WINDOW)
        self.at, owner = at[used], owner[used]
        self.order, self.firsts = _groups(marks[used])
        ordered = marks[used][self.order]
        self.distinct = ordered[self.firsts]
        mine = owner[self.order]
        if len(mine):
            self.local = np.minimum.reduceat(mine, self.firsts) != np.maximum.reduceat(mine, self.firsts)
        else:
            self.local = np.empty(0, bool)

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Word positions at which an anchor starts that some other document has too."""
        return self.at[_spread(self.order, self.firsts, self.local | elsewhere)]


def _bits(answers: dict[int, bytes], counts: np.ndarray) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(answers[k], np.uint8), count=n) for k, n in enumerate(counts.tolist())]
    return np.concatenate(parts).astype(bool)


def _ask_anchors(width: int):
    def question(block: Block) -> dict[int, bytes]:
        distinct = _Anchors(block.texts).distinct
        cuts = blocks.sliced(distinct, width)
        return {k: _steps(distinct[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    return question


def _answer_anchors(bodies: list[bytes]) -> list[bytes]:
    held = [_values(b) for b in bodies]
    every = np.sort(np.concatenate(held))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    # every block looks its own hashes up: np.isin would sort all shared ones again for each block
    return [np.packbits(_among(h, shared)).tobytes() for h in held]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values the ascending array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class _Passages:
    """The passages of a block that may be repeated, grouped by their content."""

    def __init__(self, block: Block, words: Words, hashes: np.ndarray, starts: np.ndarray, first: np.ndarray):
        self.starts = starts
        self.ids = np.where(block.nulls, LAST, block.ids)[words.owner[starts]]
        other = words.hashes(1) if len(starts) else hashes
        second = span_hashes(other, starts, starts + WINDOW, 1) >> np.uint64(32)
        self.order, self.firsts = _groups(second, first)
        heads = self.order[self.firsts] if len(starts) else self.order
        self.first, self.second = first[heads], second[heads]
        self.least = np.minimum.reduceat(self.ids[self.order], self.firsts) if len(starts) else self.ids


def _extend(width: int):
    def settle(block: Block, answers: dict[int, bytes]):
        anchors = _Anchors(block.texts)
        cuts = blocks.sliced(anchors.distinct, width)
        marked = np.zeros(len(anchors.hashes) + 1, np.int32)
        marked[anchors.repeated(_bits(answers, np.diff(cuts))) + 1] = 1
        upto = np.cumsum(marked, dtype=np.int32)
        starts, first = windows(anchors.hashes, anchors.words.firsts, WINDOW)
        held = upto[starts + PERIOD] > upto[starts]
        found = _Passages(block, anchors.words, anchors.hashes, starts[held], first[held])
        cuts = blocks.sliced(found.first, width)
        yield NOTES, np.packbits(held).tobytes()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield k, b"".join([np.int64(b - a).tobytes(), _steps(found.first[a:b]),
                               packed(found.second[a:b].astype(np.uint32)), packed(found.least[a:b])])
    return settle


def _answer_passages(bodies: list[bytes]) -> list[bytes]:
    counts = [int(np.frombuffer(b, np.int64, 1)[0]) for b in bodies]
    first = np.concatenate([_values(b[8:8 + 8 * n]) for b, n in zip(bodies, counts)])
    second = np.concatenate([unpacked(b[8 + 8 * n:8 + 12 * n], np.uint32) for b, n in zip(bodies, counts)])
    least = np.concatenate([unpacked(b[8 + 12 * n:], np.int64) for b, n in zip(bodies, counts)])
    earlier = np.zeros(len(first), bool)
    if len(first):
        order, firsts = _groups(second, first)
        earlier = _spread(order, firsts, np.minimum.reduceat(least[order], firsts)) < least
    cuts = np.cumsum([0, *counts])
    return [np.packbits(earlier[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]


def _remove(width: int):
    def settle(block: Block, answers: dict[int, bytes]) -> pa.Table:
        words = words_of(block.texts)
        hashes = words.hashes()
        starts, first = windows(hashes, words.firsts, WINDOW)
        held = np.unpackbits(np.frombuffer(answers.pop(NOTES), np.uint8), count=len(starts)).astype(bool)
        found = _Passages(block, words, hashes, starts[held], first[held])
        earlier = _bits(answers, np.diff(blocks.sliced(found.first, width)))
        taken = found.starts
        if len(taken):
            taken = taken[_spread(found.order, found.firsts, earlier)
                          | (_spread(found.order, found.firsts, found.least) < found.ids)]
        edge = np.zeros(len(hashes) + WINDOW, np.int32)
        edge[taken] += 1
        edge[taken + WINDOW] -= 1
        gone = np.cumsum(edge)[:len(hashes)] > 0
        rows = []
        for k, text in enumerate(block.texts):
            a, b = words.firsts[k], words.firsts[k + 1]
            mine, own = gone[a:b], text.split()
            n = int(mine.sum())
            spans = []
            if n:
                turns = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
                spans = [{"start": s, "words": e - s} for s, e in zip(turns[::2], turns[1::2])]
                own = compress(own, (~mine).tolist())
            rows.append((None if block.nulls[k] else int(block.ids[k]), int(b - a), n, spans, b" ".join(own)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)
    return settle


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words of the text, how many are removed, their spans, and the words kept.

    A word goes if a passage of 13 words over it also starts in a document with a smaller id; passages are judged on the
    input. Null texts count as empty; texts of fewer than 13 words keep everything; repeated passages inside one document,
    and rows with equal ids, remove nothing from each other. Null ids stand after all others. Other columns are not read.
    """
    width = shuffle_width(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    anchors = blocks.answered(blocks.ask(docs, "id", "text", _ask_anchors(width)), _answer_anchors)
    passages = blocks.settled(docs, "id", "text", anchors, _extend(width))
    return blocks.settled(docs, "id", "text", blocks.answered(passages, _answer_passages), _remove(width), RESULT)
