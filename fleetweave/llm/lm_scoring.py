"""Language-model scores by a weighted backoff automaton.

The model is a smoothed bigram model of the whole training corpus. Its states are the empty history (the root) and every
word as a history; an arc for each counted pair of words carries a log-probability and leads to the second word's state,
and a failure arc leads back to the root at the price of the backoff weight. With training counts c and strength S::

    root:  P(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))
    arc:   P(w|h) = (c(h w) + S P(w)) / (c(h) + S)      where c(h w) > 0
    fail:  S / (c(h) + S), then the root's arc          otherwise

The automaton grows with the corpus and is never in one place. A block of documents asks for the counts of its distinct
words and pairs; training counts of all blocks are added where they meet, and the block then holds the part of the
automaton that its own texts can reach. One left-to-right traversal per document carries the state.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm import blocks
from fleetweave.llm.blocks import Block
from fleetweave.llm.scratch import shuffle_width
from fleetweave.llm.text import mix, packed, unpacked, words_of

STRENGTH = 64.0  # weight of the root's distribution in a history, in tokens
FLOOR = 0.1
FINER = 2  # slices per part of a shuffle, so that a slice is small beside a block
HELD_OUT = (10, 0)  # divisor and remainder of crc32 of the id as text
END, START = np.uint64(1), np.uint64(2)  # in place of word hashes
RESULT = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
_RESULT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class _Counted:
    """Token sequences of a block, its distinct words and pairs in hash order, and their counts in training texts."""

    def __init__(self, block: Block):
        words = words_of(block.texts, lower=True)
        self.sizes = words.counts + 1  # with the end
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        hashes = np.full(total, END)
        inside = np.ones(total, bool)
        inside[self.starts + self.sizes - 1] = False
        hashes[inside] = words.hashes()
        divisor, value = HELD_OUT
        self.held_out = np.array([zlib.crc32(b"" if null else str(i).encode()) % divisor == value
                                  for i, null in zip(block.ids.tolist(), block.nulls.tolist())], bool)
        weight = np.repeat(~self.held_out, self.sizes)
        self.words, inverse = np.unique(np.append(hashes, START), return_inverse=True)
        self.sequence, start = inverse[:-1].astype(np.int32), int(inverse[-1])
        self.word_counts = np.bincount(self.sequence, weight, len(self.words)).astype(np.uint64)
        self.word_counts[start] = (~self.held_out).sum()  # how often the start is a history
        self.before = np.roll(self.sequence, 1)
        self.before[self.starts] = start
        pairs = self.before.astype(np.int64) * len(self.words) + self.sequence
        self.pairs, inverse = np.unique(pairs, return_inverse=True)
        counts = np.bincount(inverse, weight, len(self.pairs)).astype(np.uint64)
        h, w = np.divmod(self.pairs, len(self.words))
        marks = mix(self.words[h] * np.uint64(0x9E3779B97F4A7C15) + self.words[w])
        self.order = np.argsort(marks, kind="stable")  # the questions' order
        self.marks, self.pair_counts = marks[self.order], counts[self.order]


def _steps(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _slices(counted: _Counted, width: int):
    return zip(*[zip(c, c[1:]) for c in (blocks.sliced(counted.words, width), blocks.sliced(counted.marks, width))])


def _ask(width: int):
    def question(block: Block) -> dict[int, bytes]:
        counted = _Counted(block)
        return {k: b"".join([np.array([b - a, d - c]).tobytes(), _steps(counted.words[a:b]),
                             packed(counted.word_counts[a:b]), _steps(counted.marks[c:d]),
                             packed(counted.pair_counts[c:d])])
                for k, ((a, b), (c, d)) in enumerate(_slices(counted, width))}
    return question


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their totals, and the total of every entry."""
    flat, each = np.concatenate(keys), np.concatenate(counts)
    distinct, inverse = np.unique(flat, return_inverse=True)
    totals = np.zeros(len(distinct), np.uint64)
    np.add.at(totals, inverse, each)
    return distinct, totals, totals[inverse]


def _answer(bodies: list[bytes]) -> list[bytes]:
    sizes = [tuple(np.frombuffer(b, np.int64, 2).tolist()) for b in bodies]
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for body, (n, m) in zip(bodies, sizes):
        at = 16
        for part, read, size in zip(parts, (_hashes, _counts, _hashes, _counts), (n, n, m, m)):
            part.append(read(body[at:at + 8 * size]))
            at += 8 * size
    words, totals, each_word = _sums(parts[0], parts[1])
    _, _, each_pair = _sums(parts[2], parts[3])
    real = words != START
    head = np.array([(totals[real] > 0).sum(), totals[real].sum()], np.uint64).tobytes()
    word_ends, pair_ends = (np.cumsum([0, *column]) for column in zip(*sizes))
    return [head + packed(each_word[word_ends[i]:word_ends[i + 1]]) + packed(each_pair[pair_ends[i]:pair_ends[i + 1]])
            for i in range(len(bodies))]


def _counts(data: bytes) -> np.ndarray:
    return unpacked(data, np.uint64)


class Automaton:
    """States are histories, numbered like words, and the root; arcs lie in order of state and word."""

    def __init__(self, words: int, arcs: np.ndarray, weights: np.ndarray, root: np.ndarray, fail: np.ndarray):
        self.words, self.root, self.fail = words, root, fail
        self.arcs, self.weights = arcs, weights  # state * words + word, log-probability

    def walk(self, sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: int) -> np.ndarray:
        """Log-probability of each text. All texts step together, each with its own state; ended ones drop out."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        states = np.full(len(order), state, np.int64)
        sums = np.zeros(len(order))
        left = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        for t, n in enumerate(left.tolist()):
            word = sequence[starts[:n] + t]
            key = states[:n] * self.words + word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            taken = self.arcs[at] == key
            # a failure arc leads to the root, which has an arc for every word
            sums[:n] += np.where(taken, self.weights[at], self.fail[states[:n]] + self.root[word])
            states[:n] = word
        out = np.empty(len(order))
        out[order] = sums
        return out


def _score(width: int):
    def settle(block: Block, answers: dict[int, bytes]) -> pa.Table:
        counted = _Counted(block)
        distinct = total = 0
        word_counts, pair_counts = [], []
        for k, ((a, b), (c, d)) in enumerate(_slices(counted, width)):
            body = answers[k]
            head = np.frombuffer(body, np.uint64, 2)
            distinct, total = distinct + int(head[0]), total + int(head[1])
            word_counts.append(_counts(body[16:16 + 8 * (b - a)]))
            pair_counts.append(_counts(body[16 + 8 * (b - a):]))
        seen = np.concatenate(word_counts).astype(np.float64)
        pairs = np.empty(len(counted.pairs))
        pairs[counted.order] = np.concatenate(pair_counts)
        plain = (seen + FLOOR) / (total + FLOOR * (distinct + 1))
        root, fail = np.log10(plain), np.log10(STRENGTH / (seen + STRENGTH))
        h, w = np.divmod(counted.pairs, len(counted.words))
        counted_arcs = pairs > 0
        weights = np.log10((pairs + STRENGTH * plain[w]) / (seen[h] + STRENGTH))
        arcs, weights = counted.pairs[counted_arcs], weights[counted_arcs]
        if not len(arcs):
            arcs, weights = np.array([-1]), np.zeros(1)
        start = int(np.searchsorted(counted.words, START))
        walk = Automaton(len(counted.words), arcs, weights, root, fail).walk
        known = np.add.reduceat((seen[counted.sequence] > 0).astype(np.int64), counted.starts)
        base = np.add.reduceat(root[counted.sequence], counted.starts)
        columns = [pa.array(block.ids, mask=block.nulls), counted.held_out, counted.sizes, known,
                   np.full(len(base), total, np.int64), base, walk(counted.sequence, counted.starts, counted.sizes, start)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)
    return settle


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), logs to base 10.

    A-Z are lower-cased; tokens are the words and one end. ``score`` is the automaton's log-probability, ``base_score`` the
    root's alone. Held-out rows (crc32 of the id as text, modulo 10, is 0; a null id counts as the empty text) are scored
    and teach nothing. Null and empty texts are their end alone. Repeated rows count as often as they stand there. Without
    any training row every token has the root's probability of an unseen one. Other columns are not read.
    """
    width = FINER * shuffle_width(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    answers = blocks.answered(blocks.ask(docs, "id", "text", _ask(width)), _answer)
    return blocks.settled(docs, "id", "text", answers, _score(width), RESULT)
