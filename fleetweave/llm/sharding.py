"""Shards of near-equal bytes by sampled splitters.

Records lie along the order of (hash of the text, id). A sample in which a record's chance is in proportion to its size
gives quantiles of the bytes; they are the splitters that cut the order into ranges. Ranges are measured, and a range
that holds too much (one text with very many copies cannot be split by its hash) is subdivided by a hash of the id.
Inside a range records are numbered and their sizes summed, ranges are added up once, and a record's place among all
bytes gives its shard. So shards differ by about one record, whatever the sample was. All of it is DataFrame code.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.llm.columns import range_of
from fleetweave.llm.scratch import stored

SHARDS = 24
OVERHEAD = 8  # bytes of a record besides its text
FEWEST, MOST = 512, 32_768  # ranges
RANGE_ROWS = 50_000  # records of a range, until there are ``MOST`` of them
DRAWS = 32  # expected draws per range
OVERFULL = 2.0  # times the mean bytes of a range


def splitters(records: DataFrame, ranges: int = FEWEST) -> list[int]:
    """Ascending keys that cut ``records(_key, _id, _size)`` into ranges of about equal bytes.

    Sampling is by hash, so it repeats exactly. The sample alone reaches the driver: ``DRAWS`` a range are expected.
    """
    total = records.agg(F.sum("_size").alias("n")).first()["n"]
    if not total:
        return []
    chance = F.col("_size") * (DRAWS * ranges / total)
    draw = F.pmod(F.xxhash64("_key", "_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    # a record larger than a sampling step is drawn once for each whole step it holds
    times = (F.floor(chance) + F.when(draw < chance - F.floor(chance), 1).otherwise(0)).cast("int")
    sample = records.select("_key", times.alias("n")).where("n > 0").groupBy("_key").agg(F.sum("n").alias("n")).collect()
    draws = [r["_key"] for r in sorted(sample) for _ in range(r["n"])]
    return sorted({draws[len(draws) * k // ranges] for k in range(1, ranges)}) if draws else []


def shards(docs: DataFrame, count: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``bytes``: shards 0 to ``count - 1`` have sizes as equal as whole records allow; ``slot`` numbers a shard's
    records from 0 without gaps; ``grown_shard`` is null. ``size`` is the text's UTF-8 bytes and 8 more, a null text has
    none. Equal texts lie side by side, so they share a shard unless a border falls between them or their range is
    subdivided. Repeated rows each get their own slot, null ids come before others, other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = stored(docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"),
                                 F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_key")))
    ranges = min(MOST, max(FEWEST, records.count() // RANGE_ROWS))
    records = records.withColumn("_range", range_of(F.col("_key"), splitters(records, ranges)))

    # one row per range, then per cell: at most that many, and as many again for every OVERFULL of them
    measured = records.groupBy("_range").agg(F.sum("_size").alias("_bytes"))
    total = measured.agg(F.sum("_bytes")).scalar()
    parts = F.greatest(F.lit(1), F.ceil(F.col("_bytes") * ranges / (OVERFULL * total)).cast("int"))
    divided = records.join(F.broadcast(measured.select("_range", parts.alias("_parts"))), "_range")
    divided = divided.withColumn("_part", F.pmod(F.xxhash64("_id", "_crc", F.lit("part")), F.col("_parts")).cast("int"))
    cells = divided.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_range", "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_first_byte"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first_row"))

    inside = Window.partitionBy("_range", "_part").orderBy("_key", "_id", "_size", "_crc")
    local = divided.select("_range", "_part", "_id", "_size", "_crc", F.row_number().over(inside).alias("_nth"),
                           F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    middle = F.col("_first_byte") + F.col("_upto") - F.col("_size") / 2
    placed = stored(local.join(F.broadcast(starts), ["_range", "_part"]).select(
        "_id", "_size", "_crc", (F.col("_first_row") + F.col("_nth") - 1).alias("_place"),
        F.least(F.lit(count - 1), F.floor(middle * count / total)).cast("int").alias("shard")))
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias("id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
