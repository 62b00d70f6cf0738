"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here each key's history is cut into chunks along its
order; windows run inside (key, chunk), one summary row per chunk is aggregated map-side first, the summaries are scanned
per key, and each row combines its local value with what its chunk inherits. Results are exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
HOUR = 3600.0


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def by_time(ts, seconds: float = HOUR) -> Column:
    """Chunk number of a timestamp column."""
    return F.floor(micros(ts) / int(seconds * 1_000_000)).cast("long")


def by_number(column, width: int = 4096) -> Column:
    """Chunk number of an integer column."""
    return F.floor((F.col(column) if isinstance(column, str) else column) / width).cast("long")


def _exprs(wanted) -> dict[str, Column]:
    return {name: F.col(e) if isinstance(e, str) else e for name, e in (wanted or {}).items()}


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, *, prev=None, last=None, before=None,
            first=None, total=None, peak=None) -> DataFrame:
    """Add running values over each key's rows, ordered by ``order``.

    ``chunk`` must never decrease along ``order``. Every other argument maps new column names to expressions:
    ``prev`` value on the previous row; ``last`` latest non-null value so far; ``before`` the same without the current
    row; ``first`` value on the key's first row; ``total`` running sum; ``peak`` running maximum.
    """
    prev, last, before, first, total, peak = map(_exprs, (prev, last, before, first, total, peak))
    df = df.withColumn(CHUNK, chunk)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, summary, carry = {}, [], {}
    chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    for name, e in prev.items():
        local[name] = F.lag(F.struct(e.alias("v"))).over(inside)
        summary.append(F.max_by(F.struct(e.alias("v")), position).alias(name))
        carry[name] = F.last(name).over(chunks)
    for name, e in {**last, **before}.items():
        local[name] = F.last(e, ignorenulls=True).over(upto if name in last else earlier)
        summary.append(F.max_by(e, F.when(e.isNotNull(), position)).alias(name))
        carry[name] = F.last(name, ignorenulls=True).over(chunks)
    for name, e in first.items():
        local[name] = F.first(F.struct(e.alias("v"))).over(upto)
        summary.append(F.min_by(F.struct(e.alias("v")), position).alias(name))
        carry[name] = F.first(name).over(chunks)
    for name, e in total.items():
        local[name] = F.sum(e).over(upto)
        summary.append(F.sum(e).alias(name))
        carry[name] = F.sum(name).over(chunks)
    for name, e in peak.items():
        local[name] = F.max(e).over(upto)
        summary.append(F.max(e).alias(name))
        carry[name] = F.max(name).over(chunks)

    inherited = {name: f"_from_{name}" for name in local}
    starts = (df.groupBy(*keys, CHUNK).agg(*summary)
                .select(*keys, CHUNK, *[c.alias(inherited[n]) for n, c in carry.items()]))
    rows = df.withColumns(local).join(starts, [*keys, CHUNK], "left")

    merged = {}
    for name in local:
        here, there = F.col(name), F.col(inherited[name])
        if name in prev:
            merged[name] = F.coalesce(here, there)["v"]
        elif name in first:
            merged[name] = F.coalesce(there, here)["v"]
        elif name in total:
            merged[name] = F.when(here.isNotNull() & there.isNotNull(), here + there).otherwise(F.coalesce(here, there))
        elif name in peak:
            merged[name] = F.greatest(here, there)
        else:
            merged[name] = F.coalesce(here, there)
    return rows.select(*[c for c in df.columns if c != CHUNK and c not in merged],
                       *[c.alias(n) for n, c in merged.items()])


def following(df: DataFrame, keys: list[str], ts: str, tie: str, chunk_sec: float, name: str, value) -> DataFrame:
    """Add ``value`` of the next row of the key in (ts, tie) order, by scanning backwards."""
    flipped = df.withColumns({"_back": -micros(ts), "_tie": -F.col(tie)})
    out = running(flipped, keys, ["_back", "_tie"], -by_time(ts, chunk_sec), prev={name: value})
    return out.drop("_back", "_tie")


def trailing_rows(df: DataFrame, keys: list[str], position: str, rows: int, aggregates: dict,
                  chunk_rows: int = 4096) -> DataFrame:
    """Aggregate over each row's trailing ``rows`` positions; a key has one row per ``position`` and may leave some out."""
    width = max(chunk_rows, rows)
    home = F.floor(F.col(position) / width).cast("long")
    spread = F.sequence(F.col("_home"), F.floor((F.col(position) + rows - 1) / width).cast("long"))
    split = df.withColumn("_home", home).withColumn(CHUNK, F.explode(spread))
    frame = Window.partitionBy(*keys, CHUNK).orderBy(position).rangeBetween(-(rows - 1), 0)
    return (split.withColumns({n: a.over(frame) for n, a in aggregates.items()})
                 .where(F.col(CHUNK) == F.col("_home")).drop("_home", CHUNK))


def ranked(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Number the rows of each key from 1 along ``order``, balanced whatever the key sizes.

    Rows are range-partitioned on (keys, order) and the partition numbers frozen by a table, then act as chunks.
    The result reads that table only, and ``forget`` of it deletes it.
    """
    from fleetweave.session import written

    order = [F.col(o) if isinstance(o, str) else o for o in order]
    plain = {f"_o{i}": o for i, o in enumerate(order)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (df.withColumns(plain).repartitionByRange(parts, *keys, *plain)
                .withColumn("_part", F.spark_partition_id()))
    spread = written(spread)
    out = running(spread, keys, list(plain), F.col("_part"), total={name: F.lit(1).cast("long")}).drop("_part", *plain)
    out._folder = spread._folder
    return out


FACTOR_BITS, TOP = 3, 19  # blocks of a level are eight times those below; so many levels outlast any clock


def block_of(bucket: Column, level: Column) -> Column:
    """Number of the block of a level that holds a bucket."""
    return F.call_function("shiftright", bucket, level * FACTOR_BITS)


def levels(length: Column, bucket: int) -> Column:
    """Highest level whose blocks can lie inside a span of ``length``, both in the same unit."""
    buckets = F.greatest(F.lit(1.0), (length / bucket).cast("double"))
    return F.least(F.lit(TOP), F.ceil(F.log2(buckets) / FACTOR_BITS)).cast("int")


def cover(first: Column, last: Column) -> Column:
    """Blocks (level, number) that together hold the buckets ``first`` to ``last``, each once: at most 14 a level.

    A level covers what is left of the span on either side of the next level's blocks.
    """
    up = lambda x, bits: F.call_function("shiftright", x + (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1), bits)
    down = lambda x, bits: F.call_function("shiftright", x, bits)
    wide = lambda x: F.call_function("shiftleft", x, F.lit(FACTOR_BITS))
    block = lambda level, number: F.struct(level.alias("level"), number.alias("number"))
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda n: block(level, n))).otherwise(
        F.array().cast("array<struct<level:int,number:bigint>>"))

    def of(level: Column) -> Column:
        bits = level * FACTOR_BITS
        a, b = up(first, bits), down(last + 1, bits)  # blocks of this level inside the span
        c, d = wide(up(first, bits + FACTOR_BITS)), wide(down(last + 1, bits + FACTOR_BITS))  # of which the next takes
        return F.when(c < d, F.concat(run(level, a, c), run(level, d, b))).otherwise(run(level, a, b))

    # shifts are taken modulo 64 bits, so no level may reach them
    many = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(TOP - 1), F.ceil(F.log2((last - first + 1).cast("double")) / FACTOR_BITS).cast("int"))), of))
    return F.when(first == last, F.array(block(F.lit(0), first))).otherwise(many)
