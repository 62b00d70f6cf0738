"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased runs of letters and digits; shingles are five words. For every item of n shingles, windows of n
shingles slide over the documents, word by word; a document of fewer shingles is one window as a whole. A window whose weighted
similarity to an item is 0.8 or more has at least ``need`` shingles in common with it, so windows with fewer shingles of
items of their size than that are ruled out by counting: nothing that could be verified is lost. The rest get a SimHash,
their shingles weighted by how often they stand in them.
Fingerprints are four blocks of 16 bits. Within ``RADIUS`` differing bits one block differs in ``RADIUS // 4`` bits at
most, so the index holds every such variant of every block of the items, and a window looks its four blocks up: all
pairs within the radius meet. They are verified by the weighted Jaccard similarity of their shingles.
"""
from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.columns import let
from fleetweave.llm.scratch import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
BOUND = 200_000  # benchmark shingles that are sent to every task; more are met by a shuffle
_LANES = 0x0000000100000001  # two 32-bit counters in a long


def _shingles(text: Column) -> Column:
    """Hashes of the shingles of a text in order; empty with fewer than five words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.when(
        F.size(hashes) >= SHINGLE_WORDS, F.transform(F.sequence(F.lit(1), F.size(hashes) - (SHINGLE_WORDS - 1)),
                                                     lambda i: F.xxhash64(F.slice(hashes, i, SHINGLE_WORDS))))
        .otherwise(F.array().cast("array<bigint>")))


def simhash(shingles: Column) -> Column:
    """SimHash of an array of hashes, repeats included: bit b is 1 if set in over half of them."""
    one, half = F.lit(1).cast("long"), F.size(shingles).cast("long")
    shift = lambda x, b: F.call_function("shiftrightunsigned", x, b)
    # lane b counts bits b and b + 32 in the two halves of a long
    lanes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(
        shingles, F.lit(0).cast("long"), lambda n, h: n + shift(h, b).bitwiseAND(F.lit(_LANES))))

    def bits(ones: Column, place: Column) -> Column:
        return F.when(2 * ones > half, F.call_function("shiftleft", one, place)).otherwise(F.lit(0).cast("long"))

    both = F.transform(lanes, lambda n, b: bits(n.bitwiseAND(F.lit(0xFFFFFFFF)), b)
                       .bitwiseOR(bits(shift(n, F.lit(32)), b + 32)))
    return F.aggregate(both, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _blocks(print_: Column) -> Column:
    """One row per block of a fingerprint."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(print_, k).alias("value")) for k in range(BLOCKS)])).alias("_b")


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda x, values: F.size(F.filter(values, lambda v: v == x))
    repeats = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(x, a), count(x, b)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeats)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, _n, _mine): items with a shingle at least."""
    items = benchmark.select(F.col(id_col).alias("item_id"), _shingles(F.col(text_col)).alias("_mine"))
    n = F.size("_mine")
    return items.where(n > 0).select("item_id", n.alias("_n"), "_mine")


def _small(df: DataFrame, rows: DataFrame, each: int = 1) -> DataFrame:
    """``df`` marked for broadcast if it is small, which a count of ``rows`` (``each`` rows of it per row) decides."""
    most = BOUND * 4 // each
    return F.broadcast(df) if rows.limit(most + 1).count() <= most else df


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _digest, _n, _w, _need, _at): for each document and item size the ascending positions of such items' shingles.

    ``_w`` is the size of its windows, ``_n`` or that of the whole document if smaller. Documents with fewer shingles of
    such items than ``_need`` are left out.
    """
    known = items.select(F.explode("_mine").alias("_shingle"), "_n").distinct()
    places = docs.select("_id", "_digest", F.size("_all").alias("_m"), F.posexplode("_all").alias("_pos", "_shingle"))
    w = F.least("_m", "_n")
    # common / (w + n - common) >= s  is  common >= (w + n) s / (1 + s)
    need = F.ceil(F.round((w + F.col("_n")) * (SIMILARITY / (1 + SIMILARITY)), 9)).cast("int")
    hits = places.join(_small(known, known), "_shingle").groupBy("_id", "_digest", "_n", "_m").agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
    return hits.select("_id", "_digest", "_n", w.alias("_w"), need.alias("_need"), "_at").where(F.size("_at") >= F.col("_need"))


def _starts(at: Column, n: Column, need: Column) -> Column:
    """Starts of the windows of ``n`` shingles that hold ``need`` of the positions, each once, under its first one."""
    def windows(x: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get(at, i - 1))
        low = F.greatest(before + 1, F.get(at, i + need - 1) - n + 1, F.lit(0))
        # without a position that far on there is no such window
        return F.when(F.coalesce(F.get(at, i + need - 1) <= x + n - 1, F.lit(False)), F.sequence(low, x)).otherwise(
            F.array().cast("array<int>"))

    return F.flatten(F.transform(at, windows))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, digest, item_id, start, n_words, similarity): each pair of a document and an item it holds, once, at its best window.

    Documents of fewer shingles than an item are compared with it as a whole. ``start`` counts words from 0; of equally
    similar windows the first counts. Documents without a leak have no row.
    Null, empty and short texts (fewer than five words), on either side, match nothing. Items with equal texts each get
    their rows; rows equal in id and text are one document. Other columns are not read.
    """
    items = _items(benchmark, item_col, item_text)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text"))
    hits = _hits(keyed.select("_id", "_digest", _shingles(F.col("_text")).alias("_all")), items)

    window = lambda s: F.struct(s.alias("s"), F.col("_n").alias("n"), F.col("_w").alias("w"))
    hits = hits.select(F.col("_id").alias("_hid"), F.col("_digest").alias("_hdigest"),
                       F.transform(_starts(F.col("_at"), F.col("_w"), F.col("_need")), window).alias("_windows"))
    hits = (hits.where(F.size("_windows") > 0).groupBy("_hid", "_hdigest")
            .agg(F.flatten(F.collect_list("_windows")).alias("_windows")))

    found = (keyed.join(hits, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_digest") == F.col("_hdigest")))
             .dropDuplicates(["_id", "_digest"])
             .select("_id", "_digest", "_windows", _shingles(F.col("_text")).alias("_all")))
    cut = let(F.col("_all"), lambda every: F.transform(
        F.filter("_windows", lambda w: w["s"] + w["w"] <= F.size(every)),
        lambda w: F.struct(w["s"].alias("s"), w["n"].alias("n"), F.slice(every, w["s"] + 1, w["w"]).alias("own"))))
    windows = found.select("_id", "_digest", F.explode(cut).alias("_w"))
    windows = windows.select("_id", "_digest", F.col("_w.s").alias("_start"), F.col("_w.n").alias("_n"), F.col("_w.own").alias("_own"))
    windows = stored(windows.withColumn("_print", simhash(F.col("_own"))))
    items = stored(items.withColumn("_item_print", simhash(F.col("_mine"))))

    most = RADIUS // BLOCKS
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda v: F.bit_count(v) <= most)
    variants = sum(comb(BLOCK_BITS, k) for k in range(most + 1)) * BLOCKS
    index = items.select("item_id", "_n", "_item_print", _blocks(F.col("_item_print"))).select(
        "item_id", "_n", "_item_print", "_b.block", F.explode(F.transform(flips, lambda v: F.col("_b.value").bitwiseXOR(v.cast("long")))).alias("value"))
    probes = windows.select("*", _blocks(F.col("_print"))).select(*windows.columns, "_b.block", "_b.value")
    differ = F.col("_print").bitwiseXOR(F.col("_item_print"))
    first = F.array_position(F.array(*[F.bit_count(_block(differ, k)) <= most for k in range(BLOCKS)]), True) - 1
    near = probes.join(_small(index, items, variants), ["_n", "block", "value"])
    near = near.where((F.bit_count(differ) <= RADIUS) & (first == F.col("block"))).select("_id", "_digest", "_start", "_n", "_own", "item_id")
    texts = items.select("item_id", "_mine")
    near = near.join(_small(texts, texts), "item_id")
    common = _common(F.col("_own"), F.col("_mine"))
    scored = near.withColumn("similarity", common / (F.size("_own") + F.col("_n") - common)).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("_id", "_digest", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("_start")).alias("back"))).alias("_best"), F.first(F.size("_own")).alias("_w"))
    return best.select(F.col("_id").alias("id"), F.col("_digest").alias("digest"), "item_id", (-F.col("_best.back")).alias("start"),
                       (F.col("_w") + (SHINGLE_WORDS - 1)).alias("n_words"), F.col("_best.similarity").alias("similarity"))
