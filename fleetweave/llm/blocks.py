"""Blocks of documents that ask one question of every distinct item they hold.

Documents of a task are gathered into blocks of some megabytes. A block names each of its distinct items (words,
n-grams, windows) once, in slices by item hash: that is the combining before the shuffle, so an item in a third of all
documents costs one entry per block. All entries of a slice meet in one group, which answers them; the answers go back
to the block, whose texts travel to it compressed. Nothing is broadcast, and what a task holds is one block or one
slice: slices grow in number with ``spark.sql.shuffle.partitions``.

Blocks are numbered by task and order, so ``docs`` must give the same partitions whenever it is read: a table does.
Each block carries a digest of its rows, and a block whose answers were asked by other rows fails instead of mixing them.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.text import release, texts_of

BLOCK_BYTES = 8 << 20
SCHEMA = "block long, slice int, digest long, body binary"
TEXTS, NOTES = -1, -2  # slices of a block that hold no questions
_ARROW = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("digest", pa.int64()), ("body", pa.binary())])


@dataclass
class Block:
    number: int
    ids: np.ndarray  # 0 where null
    nulls: np.ndarray  # which ids are null
    texts: list[bytes]
    digest: int


def _gather(batches, block_bytes: int) -> Iterator[Block]:
    part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def close() -> Block:
        hasher = xxhash.xxh3_64(repr(ids).encode())
        for text in texts:
            hasher.update(text)
            hasher.update(b"\xff")
        nulls = np.array([i is None for i in ids], bool)
        return Block((part << 20) + seq, np.array([0 if i is None else i for i in ids], np.int64), nulls, texts,
                     hasher.intdigest() >> 1)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if texts and held + len(text) > block_bytes:
                yield close()
                seq, ids, texts, held = seq + 1, [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)
    if texts:
        yield close()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def ask(docs: DataFrame, id_col: str, text_col: str, question: Callable[[Block], dict[int, bytes]],
        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Questions of every block: ``question`` maps a block to bodies by slice."""
    def run(batches):
        for block in _gather(batches, block_bytes):
            for number, body in question(block).items():
                yield _rows([(block.number, number, block.digest, body)])
            release()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def answered(questions: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Answer each slice: ``answer`` turns the bodies of all blocks into one body per block. Notes pass through."""
    def run(table):
        if table.column("slice")[0].as_py() < 0:
            return table
        bodies = answer(table.column("body").to_pylist())
        release()
        return table.set_column(3, _ARROW.field("body"), pa.array(bodies, pa.binary()))

    # notes are only carried along: they are dealt by block so that they spread
    keyed = questions.withColumn("deal", F.when(F.col("slice") < 0, -1 - F.col("block")).otherwise(F.col("slice")))
    return keyed.groupBy("deal").applyInArrow(lambda table: run(table.select(_ARROW.names)), SCHEMA)


def _texts(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    def body(block: Block) -> dict[int, bytes]:
        sizes = np.array([len(t) for t in block.texts], np.int64)
        plain = b"".join([np.int64(len(sizes)).tobytes(), block.ids.tobytes(), block.nulls.tobytes(), sizes.tobytes(),
                          *block.texts])
        return {TEXTS: zstandard.ZstdCompressor(level=3).compress(plain)}

    return ask(docs, id_col, text_col, body, block_bytes)


def _restored(number: int, digest: int, body: bytes) -> Block:
    plain = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    ids = np.frombuffer(plain, np.int64, n, 8)
    nulls = np.frombuffer(plain, bool, n, 8 + 8 * n)
    ends = np.cumsum(np.frombuffer(plain, np.int64, n, 8 + 9 * n)) + 8 + 17 * n
    starts = np.concatenate(([8 + 17 * n], ends[:-1]))
    return Block(number, ids, nulls, [plain[a:b] for a, b in zip(starts, ends)], digest)


def settled(docs: DataFrame, id_col: str, text_col: str, answers: DataFrame,
            settle: Callable[[Block, dict[int, bytes]], pa.Table | list[tuple]], schema: str | None = None,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Bring each block's texts and answers together; ``settle`` makes the result rows, or the next questions.

    Without ``schema`` the result is questions again, a list of (slice, body).
    """
    def run(table):
        if len(set(table.column("digest").to_pylist())) > 1:
            raise ValueError("a block was read twice with different rows; pass a table, not a shuffled result")
        number, digest = table.column("block")[0].as_py(), table.column("digest")[0].as_py()
        bodies = dict(zip(table.column("slice").to_pylist(), table.column("body").to_pylist()))
        out = settle(_restored(number, digest, bodies.pop(TEXTS)), bodies)
        if schema is None:
            out = pa.Table.from_batches([_rows([(number, s, digest, b) for s, b in out])], _ARROW)
        release()
        return out

    both = _texts(docs, id_col, text_col, block_bytes).unionByName(answers)
    return both.groupBy("block").applyInArrow(run, schema or SCHEMA)


def sliced(ordered: np.ndarray, width: int) -> np.ndarray:
    """Borders of the slices in an ascending array of hashes."""
    marks = np.array([(k << 64) // width for k in range(1, width)], np.uint64)
    return np.concatenate(([0], np.searchsorted(ordered, marks), [len(ordered)])).astype(np.int64)
