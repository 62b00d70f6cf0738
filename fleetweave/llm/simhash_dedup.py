"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Each differing bit spoils one byte at most, so fingerprints at ``radius``
or fewer differing bits share at least ``8 - radius`` positional bytes. The index posts every distinct fingerprint under
each choice of that many positions, so the pairs that meet are exactly those whose tally reaches the minimum; the tally
and the shared positions are read off the pair's difference, and the pair is verified where it first meets.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.hot_keys import looked_up
from fleetweave.llm.linking import components
from fleetweave.llm.scratch import stored
from fleetweave.llm.text import chunks, release, texts_of

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
POSITIONS = 8


def _print_of(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text; empty without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    plain = b" ".join(words)
    last = max(1, len(words) - size + 1)
    starts, at = [0], 0
    for word in words:
        at += len(word) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(plain[a:b - 1], SEED) for a, b in zip(starts[:last], starts[min(size, len(words)):])),
                       np.uint64, last)


def simhashes(texts: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """One fingerprint per text: a bit is 1 if set in over half of the text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for part in chunks(texts, 1 << 20):
        found = [_print_of(t, size) for t in texts[part]]
        counts = np.array([len(h) for h in found])
        full = np.flatnonzero(counts)
        if len(full):
            bits = np.unpackbits(np.concatenate(found).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            firsts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
            ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
            set_bits = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little")
            out[part.start + full] = set_bits.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, digest): fingerprint of every row as a signed long and a hash of its text; wordless texts have 0."""
    kind = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("digest", pa.int64())])

    def run(batches):
        for batch in batches:
            prints = simhashes(texts_of(batch.column(1)), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], schema=kind)
            release()

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, "id long, fp long, digest long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, at ``radius`` or fewer differing bits; each pair once."""
    shared = POSITIONS - radius
    postings = []
    for places in combinations(range(POSITIONS), shared):
        mask = sum(0xFF << 8 * p for p in places)
        code = sum(1 << p for p in places)
        signed = mask - (1 << 64) if mask >> 63 else mask
        postings.append(F.struct(F.lit(code).alias("code"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes")))
    index = prints.select("fp").distinct().select("fp", F.explode(F.array(*postings)).alias("_p"))
    index = index.select("fp", F.col("_p.code").alias("code"), F.col("_p.bytes").alias("bytes"))

    a, b = index.select(F.col("fp").alias("a"), "code", "bytes"), index.select(F.col("fp").alias("b"), "code", "bytes")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.when(F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0, 1 << p).otherwise(0)
            for p in range(POSITIONS)]
    meets = sum(same[1:], same[0])
    rest = meets
    for _ in range(shared):
        rest = rest.bitwiseAND(rest - 1)
    # the tally reaches the minimum by meeting at all; the lowest shared positions name the one posting that reports it
    first = meets.bitwiseXOR(rest) == F.col("code")
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & first
    # Spark sizes the index like the fingerprints it is unfolded from, 70 times too low, and would broadcast it whole
    return a.hint("merge").join(b.hint("merge"), ["code", "bytes"]).where(near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """One row per input row: (id, fp, component_id), the smallest id reachable over links of fingerprints.

    Equal fingerprints are one node, however many rows have them. Null texts and texts without words have fingerprint 0
    and link like any other; a null id is never a component id, so a component of null ids alone has a null one.
    Repeated rows stay repeated; other columns are not read. An empty table gives an empty result.
    """
    prints, labelled, roots = _grouped(docs, id_col, text_col, size, radius)
    named = looked_up(labelled, roots.select("root", "first", "members"), "root", F.col("members"), labelled.count())
    named = stored(named.select("fp", "rows", F.col("first.id").alias("component_id")))
    return looked_up(prints.select("id", "fp"), named, "fp", F.col("rows"), prints.count()).select("id", "fp", "component_id")


def _grouped(docs, id_col, text_col, size, radius) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, fp, digest), fingerprints (fp, rows, root), and roots (root, members, first): members are fingerprints,
    ``first`` the row of the group that comes first by id and text.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size))
    groups = components(links(prints, radius)).toDF("fp", "root")
    place = F.struct(F.col("id").isNull().alias("null"), "id", "digest")
    held = prints.groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("rows"))
    labelled = stored(held.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = stored(labelled.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members")))
    return prints, labelled.select("fp", "rows", "root"), roots


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                 radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one row left of each group: the first by id, null last, then by a hash of its text.

    Repeated rows are one group's like any other, so one of them stays. All columns pass through.
    """
    _, _, roots = _grouped(docs, id_col, text_col, size, radius)
    kept = roots.select(F.col("first.id").alias("_kept_id"), F.col("first.digest").alias("_kept_digest"))
    digest = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(id_col).cast("long").alias("_row_id"), digest.alias("_row_digest"))
    same = F.col("_row_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_digest") == F.col("_kept_digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_row_id", "_row_digest"]).select("_row.*")
