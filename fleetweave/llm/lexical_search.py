"""Ranked lexical search: documents as an FP-tree of restricted term vectors, searched by branch and bound per item.

A document keeps only the terms that some item asks for, in order of falling document frequency, so documents that hold
the same frequent terms share a path of the trie. The trie of a block of documents is read off their sorted vectors and
the lengths of their common prefixes. Its large subtrees are inner nodes, runs of sibling subtrees of at most ``PAGE``
documents are leaves. A node knows the greatest ``tf`` of every term and the least ``m`` below it; a term's part of the
score rises with ``tf`` and falls with ``m``, so these give an upper bound of all scores in the subtree. Each item walks
the tree depth first, best child first, and leaves out subtrees that can't reach its tenth score. The best of a task's
blocks pass on to its next one; what tasks find is ranked in a window that keeps ten rows an item before the shuffle.

Items come in blocks of bounded bytes, each a pass over the documents: what is sent to tasks never grows with either table.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.llm.scratch import stored
from fleetweave.llm.text import _LOWER, Words, chunks, release, span_hashes, texts_of

K = 10
ITEM_BYTES = 1 << 20  # item texts searched in one pass
BLOCK_ROWS, PAGE = 16_384, 128  # documents of a tree, of a leaf
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_VECTOR = "id long, n long, terms array<int>, tfs array<int>"
_HIT = "item int, id long, score long"


def terms_of(texts: list[bytes]) -> Words:
    """Runs of ASCII letters, digits and everything beyond ASCII, with only A-Z in lower case."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.concatenate(([False], _INSIDE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))))
    return Words(data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(firsts)), firsts)


@dataclass
class Questions:
    """Items of one pass: their distinct terms are numbered, ``low`` ascending, and told apart by 128 bits of hash."""

    low: np.ndarray
    high: np.ndarray
    of_item: list[np.ndarray]

    @staticmethod
    def of(texts: list[bytes]) -> Questions:
        words = terms_of(texts)
        pairs = np.array(list(zip(words.hashes(0).tolist(), words.hashes(1).tolist())), np.uint64).reshape(-1, 2)
        kinds, number = np.unique(pairs, axis=0, return_inverse=True)
        number = number.reshape(-1)
        of_item = [np.unique(number[a:b]) for a, b in zip(words.firsts[:-1], words.firsts[1:])]
        return Questions(kinds[:, 0].copy(), kinds[:, 1].copy(), of_item)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term number) of every word that some item asks for."""
        hashes = words.hashes(0)
        first = np.searchsorted(self.low, hashes)
        at = np.flatnonzero(self.low[np.minimum(first, len(self.low) - 1)] == hashes)
        first = first[at]
        other = span_hashes(words.data, words.starts[at], words.ends[at], 1)
        last = np.searchsorted(self.low, hashes[at], "right")
        found = np.full(len(at), -1)
        for step in range(int((last - first).max(initial=0))):  # one, unless two terms share their first 64 bits
            number = np.minimum(first + step, len(self.low) - 1)
            same = (first + step < last) & (self.high[number] == other)
            found[same] = number[same]
        return at[found >= 0], found[found >= 0]


def _vectors(docs: DataFrame, id_col: str, text_col: str, asked: Questions) -> DataFrame:
    """Every document's number of terms and its restricted term vector; a null text has no terms."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in chunks(texts):
                words = terms_of(texts[part])
                at, number = asked.hits(words) if len(asked.low) else (np.empty(0, int), np.empty(0, int))
                key, tf = np.unique(words.owner[at] * max(1, len(asked.low)) + number, return_counts=True)
                owner, number = np.divmod(key, max(1, len(asked.low)))
                offsets = np.searchsorted(owner, np.arange(part.stop - part.start + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (number, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(words.counts), *lists],
                                                 names=["id", "n", "terms", "tfs"])
            release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _VECTOR)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight; it never falls when ``tf`` rises or ``m`` falls."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of some documents. Entries of a document lie together, by term rank; documents lie in trie order."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, m: np.ndarray, ranks: list[np.ndarray], tfs: list[np.ndarray], width: int):
        paths = [np.sort(r).astype(">u4").tobytes() for r in ranks]
        order = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids, self.nulls, self.m = ids[order], nulls[order], m[order]
        sizes = np.array([len(ranks[k]) for k in order], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.owner = np.repeat(np.arange(len(order)), sizes)
        rank, tf = (np.concatenate([v[k] for k in order]) for v in (ranks, tfs))
        within = np.lexsort((rank, self.owner))
        self.rank, self.tf = rank[within], tf[within].astype(np.int64)
        self._grow(self._common(sizes), width)

    def _common(self, sizes: np.ndarray) -> np.ndarray:
        """Length of the path that each document shares with the one before it."""
        out, live, depth = np.zeros(len(sizes), np.int64), np.arange(1, len(sizes)), 0
        while len(live):
            live = live[(sizes[live] > depth) & (sizes[live - 1] > depth)]
            live = live[self.rank[self.starts[live] + depth] == self.rank[self.starts[live - 1] + depth]]
            depth += 1
            out[live] = depth
        return out

    def _grow(self, common: np.ndarray, width: int) -> None:
        """Nodes as ranges of documents, children after their parents, with what lies below them."""
        spans, self.children, todo = [(0, len(self.m))], [[]], [0]
        while todo:
            node = todo.pop()
            low, high = spans[node]
            if high - low <= PAGE:
                continue
            branch = common[low + 1:high]
            cuts = np.concatenate(([low], low + 1 + np.flatnonzero(branch == branch.min()), [high]))
            held = low
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                # small siblings fill one leaf; a large one ends it and is a node of its own
                parts = [(held, a)] if b - held > PAGE and a > held else []
                held = a if parts else held
                if b - held > PAGE or b == high:
                    parts, held = [*parts, (held, b)], b
                for span in parts:
                    self.children[node].append(len(spans))
                    todo.append(len(spans))
                    spans.append(span)
                    self.children.append([])
        self.spans = spans
        self.most, self.least = np.zeros((len(spans), width), np.int64), np.zeros(len(spans), np.int64)
        for node in range(len(spans) - 1, -1, -1):
            low, high = spans[node]
            self.least[node] = self.m[low:high].min()
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(axis=0)
            else:
                at = slice(self.starts[low], self.starts[high])
                np.maximum.at(self.most[node], self.rank[at], self.tf[at])

    def search(self, ranks: np.ndarray, weights: np.ndarray, slot: np.ndarray, best: Best) -> None:
        """Add the documents that may belong to the best of an item; ``slot`` maps a rank to the item's term, or -1."""
        bounds = (share(self.most[:, ranks], self.least[:, None]) * weights).sum(axis=1)
        stack = [0]
        while stack:
            node = stack.pop()
            if bounds[node] < best.floor:
                continue
            if self.children[node]:
                stack.extend(sorted(self.children[node], key=bounds.__getitem__))  # the best child is taken first
                continue
            low, high = self.spans[node]
            at = np.arange(self.starts[low], self.starts[high])
            term = slot[self.rank[at]]
            at, term = at[term >= 0], term[term >= 0]
            parts = weights[term] * share(self.tf[at], self.m[self.owner[at]])
            # sums stay below 2 ** 53, where doubles are exact
            scores = np.bincount(self.owner[at] - low, parts, high - low).astype(np.int64)
            good = np.flatnonzero(scores >= best.floor)
            best.add(scores[good], self.ids[low:high][good], self.nulls[low:high][good])


class Best:
    """The ``k`` best (score, id) seen; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(both) for both in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        top = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[top], ids[top], nulls[top]
        if len(top) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def _found(vectors: DataFrame, asked: Questions, rank: np.ndarray, weight: np.ndarray, rows: int, total: int, k: int) -> DataFrame:
    """The best documents of every task for every item."""
    def run(batches):
        items = [np.sort(rank[t]) for t in asked.of_item]
        best = [Best(k) for _ in items]
        held, size = [], 0

        def search():
            table = pa.Table.from_batches(held)
            ids = table.column("id").combine_chunks()
            n = table.column("n").to_numpy()
            wide = int(n.max()) * rows * 90 >= 1 << 62
            m = (10 + np.array([90 * v * rows // total for v in n.tolist()], np.int64)) if wide else 10 + (90 * n * rows) // total
            terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
            cuts = np.cumsum(np.diff(terms.offsets.to_numpy()))[:-1]
            lists = [np.split(values, cuts) for values in (rank[terms.flatten().to_numpy()], tfs.flatten().to_numpy())]
            tree = Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), m, *lists, len(rank))
            slot = np.full(len(rank), -1)
            for own, so_far in zip(items, best):
                if len(own):
                    slot[own] = np.arange(len(own))
                    tree.search(own, weight[own], slot, so_far)
                    slot[own] = -1
            release()

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if held and size + part.num_rows > BLOCK_ROWS:
                    search()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            search()
        for item, b in enumerate(best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), item, np.int32)), pa.array(b.ids, mask=b.nulls), pa.array(b.scores)],
                                                 names=["item", "id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(run, _HIT)


def _pass(docs: DataFrame, ids: list, texts: list[bytes], id_col: str, text_col: str, k: int) -> DataFrame:
    asked = Questions.of(texts)
    vectors = stored(_vectors(docs, id_col, text_col, asked))
    rows, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(asked.low), np.int64)
    # as many rows as the pass has distinct terms
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[term] = df
    weight = np.floor(1000 * np.log((2 * rows + 2) / (2 * frequency + 1))).astype(np.int64)
    falling = np.lexsort((np.arange(len(frequency)), -frequency))
    rank = np.empty(len(frequency), np.int64)
    rank[falling] = np.arange(len(frequency))
    found = _found(vectors, asked, rank, weight[falling], rows, max(1, total), k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of every row of ``items``.

    Equal scores are ranked by ascending id, null ids last. Repeated documents are ranked each; repeated items, and items
    of one id or null ids, are asked each. Null and empty texts have no terms, so such documents are never found and such
    items find nothing. Other columns are not read.
    """
    item_text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), item_text.alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = 1 + size // ITEM_BYTES
    found = None
    for number in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).orderBy("item_id", "text").collect()
        some = _pass(docs, [r["item_id"] for r in own], [r["text"].encode() for r in own], id_col, text_col, k)
        found = some if found is None else found.unionByName(some)
    return found
