"""Words and their hashes for many texts at once, as numpy arrays.

Words are runs of anything but the six ASCII white-space bytes, so they are cut on UTF-8 bytes without decoding. Hashes
are polynomial prefix sums over the bytes, mixed to 64 bits: equal words have equal hashes in every task and run.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20  # bytes or words hashed in one go
CHUNK_BYTES = 4 << 20  # texts handled together

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Hand freed memory back to the system: a worker serves many tasks, and what it keeps adds up beside the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers:
        both = []
        for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            steps = np.full(PIECE, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = tuple(both)
    return _powers[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``values[start:end]``; starts and ends never decrease."""
    forth, back = _tables(base)
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = int(ends[j - 1])
        if high - low > PIECE:  # one span longer than a piece
            out[i] = xxhash.xxh64_intdigest(values[low:high].tobytes(), base)
        else:
            part = values[low:high].astype(np.uint64)
            part += np.uint64(1)
            part *= forth[: high - low]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * back[np.minimum(s, PIECE - 1)]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Words:
    """Words of a list of texts; word i is ``data[starts[i]:ends[i]]`` and belongs to text ``owner[i]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    firsts: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def hashes(self, base: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, base)


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Cut texts into words; ``lower`` turns A-Z into a-z first and leaves every other byte."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    borders = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    firsts = np.searchsorted(starts, borders)
    return Words(data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(firsts)), firsts)


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of ``size`` words that lie inside one text."""
    room = np.maximum(np.diff(firsts) - size + 1, 0)
    at = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(int(room.sum()))
    return at, span_hashes(hashes, at, at + size, base)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive slices of a list of texts of about ``limit`` bytes each, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def packed(array: np.ndarray) -> bytes:
    """Bytes of an array, first bytes of all numbers first, so that leading zeros compress well."""
    return np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, len(data) // kind.itemsize)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)
