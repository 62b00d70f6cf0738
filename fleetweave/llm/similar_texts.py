"""Near-duplicate texts: SimHash groups and positional minima bring texts together, their five-word shingles decide.

Texts have a SimHash, and those that its byte-position index links (``simhash_dedup.links``) are a bucket. At a similarity
of 0.8 two SimHashes differ in some ten bits of 64, more than the index reaches, so ``BANDS`` groups of ``ROWS``
positional minima of the hashed shingles are buckets too: a position of two texts agrees with a chance that equals their
similarity, so a pair at 0.8 shares a whole group with a chance of 0.99995, more above. Of the texts of a bucket, every
pair that may reach 0.8 is verified on the shingles themselves, unless links found before connect it already: a prefix
filter finds them without pairing all texts of a bucket.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm import simhash_dedup
from fleetweave.llm.linking import components
from fleetweave.llm.scratch import stored
from fleetweave.llm.text import chunks, mix, release, span_hashes, texts_of, words_of

SHINGLE_WORDS = 5
TIMES, PARTS = 4, 9  # similarity 0.8 or more is common * PARTS >= (size + size) * TIMES
BANDS, ROWS = 25, 5
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_PRINT = "id long, digest long, node long, size int, fp long, keys array<long>"
_SET = "node long, size int, shingles array<long>"


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text; a text of fewer words is one shingle, one without words has none."""
    words = words_of(texts, lower=True)
    counts = words.counts
    room = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    borders = np.concatenate(([0], np.cumsum(room)))
    at = np.repeat(words.firsts[:-1] - borders[:-1], room) + np.arange(borders[-1])
    found = span_hashes(words.hashes(), at, np.minimum(at + size, np.repeat(words.firsts[1:], room)))
    return [np.unique(found[a:b]) for a, b in zip(borders[:-1], borders[1:])]


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys per set; no set may be empty."""
    values = np.concatenate(sets)
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for factor in _FACTORS[band * ROWS:(band + 1) * ROWS]:
            key = mix(key ^ np.minimum.reduceat(values * factor, firsts))
        out[:, band] = key
    return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, node, size, fp, keys) of every row; texts with the same shingles are one node, 0 if they have no words."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in chunks(texts):
                sets = _sets(texts[part], SHINGLE_WORDS)
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
                full = np.flatnonzero([len(s) for s in sets])
                keys = [np.empty(0, np.uint64)] * len(sets)
                for k, row in zip(full, _keys([sets[k] for k in full]) if len(full) else []):
                    keys[k] = row
                prints = simhash_dedup.simhashes(texts[part], SHINGLE_WORDS).view(np.int64)
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array(nodes.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(prints), _lists(keys)], names=["id", "digest", "node", "size", "fp", "keys"])
            release()

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, _PRINT)


def _shingled(rows: DataFrame) -> DataFrame:
    """(node, size, shingles) of rows (node, text)."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in chunks(texts):
                sets = _sets(texts[part], SHINGLE_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(sets)), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)],
                    names=["node", "size", "shingles"])
            release()

    return rows.mapInArrow(run, _SET)


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("_row_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_row_digest")]


def _is_row(id_col: str, digest: str):
    return F.col("_row_id").eqNullSafe(F.col(id_col)) & (F.col("_row_digest") == F.col(digest))


def _posts(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(shingle, node, size, place, short): the rarest shingles of every text, which any text at 0.8 or more must meet.

    Shingles are ordered by the number of texts that hold them. Two sets of x >= y shingles with a similarity of 0.8 have
    c >= 4/9 (x + y) in common, which is at least 0.8 x and 8/9 y; so one of the first x - c + 1 shingles of the longer text
    is among the first y - c + 1 of the shorter one (``short``). Shingles that one text alone holds take the first places
    and meet nothing: texts that differ in enough of them are never paired, however many share a bucket.
    """
    held = texts.select("node").join(sets, "node").select("node", "size", F.explode("shingles").alias("shingle"))
    shared = held.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    ordered = (held.join(shared, "shingle").groupBy("node", "size")
               .agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("found")))
    places = ordered.select("node", "size", (F.col("size") - F.size("found")).alias("alone"), F.posexplode("found").alias("k", "post"))
    placed = places.select("post.shingle", "node", "size", (F.col("alone") + F.col("k")).alias("place"))
    rare = lambda times, parts: F.col("place") <= F.col("size") - F.ceil(F.col("size") * times / parts)
    return placed.where(rare(TIMES, PARTS - TIMES)).withColumn("short", rare(2 * TIMES, PARTS))


def _may_be_close(x: str, y: str):
    """For posts of a longer text x and a shorter one y whose first common shingle this is."""
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    most = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return (most * PARTS >= sizes * TIMES) & (F.col(f"{x}.size") * TIMES <= F.col(f"{y}.size") * (PARTS - TIMES))


def _first_of_each(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of every post with the one of its shingle that stands first in its text: as many as posts at most."""
    heads = posts.groupBy("shingle").agg(F.min(F.struct("place", "size", "node")).alias("h")).select(
        "shingle", F.col("h.place").alias("place"), F.col("h.size").alias("size"), F.col("h.node").alias("node"))
    p, h = posts.alias("p"), heads.alias("h")
    ok = F.when(F.col("p.size") >= F.col("h.size"), _may_be_close("p", "h")).otherwise(_may_be_close("h", "p"))
    met = p.join(h, (F.col("p.shingle") == F.col("h.shingle")) & (F.col("p.node") != F.col("h.node")) & ok)
    return met.select(F.least("p.node", "h.node").alias("a"), F.greatest("p.node", "h.node").alias("b")).distinct()


def _meeting(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different groups that may be at 0.8."""
    x, y = posts.alias("x"), posts.where("short").alias("y")
    longer = F.struct("x.size", "x.node") > F.struct("y.size", "y.node")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & longer & (F.col("x.root") != F.col("y.root")) & _may_be_close("x", "y"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _new(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _entries(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, size) of the buckets that a text lies in: the group of its SimHash, and those of its positional minima.

    Texts of equal shingles that repeat them differently have SimHashes of their own; their node is in the group of each.
    """
    hashed = prints.where("size > 0").select("node", "size", "fp").distinct()
    groups = components(simhash_dedup.links(hashed)).toDF("fp", "root")
    near = hashed.join(groups, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node", "size")
    return near.distinct().unionByName(nodes.where("size > 0").select(F.explode("keys").alias("key"), "node", "size"))


def _links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of different nodes at similarity 0.8 or more that connect all such candidates.

    First the texts of a bucket are compared with its least one only, so a dense bucket costs one pair a text. What is
    then connected needs no further comparison. The texts of buckets that are still in several groups meet by prefix
    shingles (``_posts``): again with the first text of each only, then all that are still apart.
    """
    entries = stored(_entries(prints, nodes))
    heads = (entries.groupBy("key").agg(F.min(F.struct("node", "size")).alias("h"), F.count("*").alias("n"))
             .where("n > 1").select("key", "h.node", "h.size").toDF("key", "head", "head_size"))
    entries = stored(entries.join(heads, "key"))
    close = lambda x, y: F.greatest(x, y) * TIMES <= F.least(x, y) * (PARTS - TIMES)
    stars = stored(entries.where(F.col("node") != F.col("head")).where(close("size", "head_size"))
                   .select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())

    wanted = entries.select("node").distinct().join(nodes.select("node", "least.id", "least.digest"), "node")
    rows = docs.select(*_row_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("_text"))
    texts = rows.join(wanted, _is_row("id", "digest")).dropDuplicates(["node"]).select("node", "_text")
    sets = stored(_shingled(texts))

    def verified(pairs: DataFrame) -> DataFrame:
        found = (pairs.join(sets.toDF("a", "size_a", "of_a"), "a").join(sets.toDF("b", "size_b", "of_b"), "b")
                 .withColumn("common", F.size(F.array_intersect("of_a", "of_b"))))
        return found.where(F.col("common") * PARTS >= (F.col("size_a") + F.col("size_b")) * TIMES).select("a", "b")

    first = stored(verified(stars))
    def mixed(links: DataFrame) -> DataFrame:
        """(node, root, size) of the texts in buckets that links have not yet made one group."""
        labelled = entries.join(components(links).toDF("node", "root"), "node", "left").select(
            "key", "node", "size", F.coalesce("root", "node").alias("root"))
        open_keys = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        return labelled.join(open_keys, "key").select("node", "root", "size").distinct()

    unsettled = stored(mixed(first))
    posts = stored(_posts(unsettled, sets))
    second = stored(verified(_new(_first_of_each(posts), stars)))
    linked = first.unionByName(second)
    roots = components(linked).toDF("node", "root")
    rest = _new(_meeting(posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))), stars)
    return linked.unionByName(verified(rest))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each group: the first by id, null last, then by a hash of its text.

    Groups are what links of similarity 0.8 or more connect. Null texts and texts without words are one group, repeated
    rows too. All columns pass through.
    """
    prints = stored(_prints(docs, id_col, text_col))
    place = F.struct(F.col("id").isNull().alias("null"), "id", "digest")
    # a node's keys follow from it, so any of its rows has them
    nodes = stored(prints.groupBy("node").agg(F.min(place).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    groups = components(_links(docs, prints, nodes, id_col, text_col)).toDF("node", "root")
    held = nodes.select("node", "least").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = held.agg(F.min("least").alias("first")).select(F.col("first.id").alias("_kept_id"), F.col("first.digest").alias("_kept_digest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_row_key(docs, id_col, text_col))
    return (rows.join(kept, _is_row("_kept_id", "_kept_digest"), "left_semi")
            .dropDuplicates(["_row_id", "_row_digest"]).select("_row.*"))
