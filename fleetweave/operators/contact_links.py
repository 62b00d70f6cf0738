"""A sparse graph with the connectivity of the in-range graph, without listing its pairs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.geometry import distance
from fleetweave.operators.proximity import CELL_EDGE, FARTHEST
from fleetweave.session import cut_lineage, is_empty

DIRECT = 16  # pairs of boxes or points, per robot, that are judged at once instead of being divided further
SPLIT_BITS = 2  # a box is divided into 4 by 4
DEEPEST = 12  # divisions after which points are judged one by one: boxes of 2**-24 cells


def contact_links(positions: DataFrame, comm_range: float = 3.0, keys: list[str] | None = None, direct: float = DIRECT) -> DataFrame:
    """(keys, i, j), i < j: links that join the same robots as the pairs in range do, and name every robot that has a partner.

    ``positions(keys, robot_id, x, y)``, one row per robot and key. Two robots of a grid cell are always in range, so each
    is linked to the cell's smallest id: a cell full of robots costs a row each. Of two cells in reach it only matters
    whether any pair between them is in range; their smallest ids are linked then, in range or not. Both are described by the boxes round their points: the farthest corners in
    range are a witness for all points, the nearest corners out of range rule all out. Box pairs between the two are
    divided, until the cells are joined or ruled out; few boxes lie so near the range that they stay open. Once the points
    left make no more than ``direct`` pairs a robot, they are judged themselves, so work follows the number of robots and the
    result is exact. Corners are compared by the pairs' own arithmetic, which is monotone, so both agree to the last bit.
    Positions that are null, not finite or past ``FARTHEST`` cells are out of everyone's range. For connectivity, components and isolation
    use these in place of ``in_range_pairs``.
    """
    keys = keys or ["run_id"]
    edge, spot, sub = comm_range * CELL_EDGE, [*keys, "_cx", "_cy"], ["_u", "_v"]
    known = (F.abs("x") < edge * FARTHEST) & (F.abs("y") < edge * FARTHEST)
    scaled = positions.where(known).select(*keys, "robot_id", "x", "y", (F.col("x") / edge).alias("_fx"), (F.col("y") / edge).alias("_fy"))
    placed = cut_lineage(scaled.withColumns({"_cx": F.floor("_fx"), "_cy": F.floor("_fy")})
                         .withColumns({"_fx": F.col("_fx") - F.floor("_fx"), "_fy": F.col("_fy") - F.floor("_fy")}))
    cells = cut_lineage(placed.groupBy(*spot).agg(F.min("robot_id").alias("_head"), *_box()))
    heads = cells.select(*spot, "_head")
    links = [placed.join(heads, spot).where("robot_id <> _head").select(*keys, F.col("_head").alias("i"), F.col("robot_id").alias("j"))]

    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)
                                if (i, j) > (0, 0)])).alias("_step")
    start = cells.select(*keys, F.struct("_cx", "_cy", *[F.lit(0).cast("long").alias(c) for c in sub]).alias("a"), F.col("_b").alias("_ba"),
                         "_cx", "_cy", steps)
    start = start.withColumns({"_cx": F.col("_cx") + F.col("_step.i"), "_cy": F.col("_cy") + F.col("_step.j")}).drop("_step")
    other = cells.select(*spot, F.struct("_cx", "_cy", *[F.lit(0).cast("long").alias(c) for c in sub]).alias("b"), F.col("_b").alias("_bb"))
    pairs = start.join(other, spot).drop("_cx", "_cy")
    robots, between, last, depth = placed.count(), [*keys, "_a", "_z"], False, 0
    while True:
        near, far = _reach("_ba", "_bb")
        judged = pairs.where(near < comm_range).withColumn("_joined", far < comm_range)
        cell = lambda end: F.struct(f"{end}._cx", f"{end}._cy")
        judged = cut_lineage(judged.withColumns({"_a": cell("a"), "_z": cell("b")}))
        found = judged.where("_joined").select(*between).distinct()
        ends = [heads.select(*keys, F.struct("_cx", "_cy").alias(end), F.col("_head").alias(f"_head{end}")) for end in ("_a", "_z")]
        links.append(found.join(ends[0], [*keys, "_a"]).join(ends[1], [*keys, "_z"])
                     .select(*keys, F.col("_head_a").alias("i"), F.col("_head_z").alias("j")))
        still = judged.where("not _joined").join(found, between, "left_anti")
        if last or is_empty(still):
            break
        # Boxes of one point are exact already; what is left is divided, or judged point by point where that is little.
        work = still.agg(F.sum(F.col("_ba.n").cast("double") * F.col("_bb.n"))).first()[0]
        last = work <= direct * robots or depth == DEEPEST
        pairs = _divided(still, placed, keys, depth, last)
        depth += 1
    every = reduce(DataFrame.unionByName, links)
    return every.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def _box() -> list[Column]:
    return [F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                     F.count("*").alias("n")).alias("_b")]


def _reach(a: str, b: str) -> tuple[Column, Column]:
    """Distance between the nearest and between the farthest places of two boxes."""
    gap = lambda lo, hi: F.greatest(F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.lit(0.0))
    span = lambda lo, hi: F.greatest(F.col(f"{b}.{hi}") - F.col(f"{a}.{lo}"), F.col(f"{a}.{hi}") - F.col(f"{b}.{lo}"))
    none = F.lit(0.0)
    return (distance(gap("x0", "x1"), gap("y0", "y1"), none, none), distance(span("x0", "x1"), span("y0", "y1"), none, none))


def _divided(pairs: DataFrame, placed: DataFrame, keys: list[str], depth: int, points: bool) -> DataFrame:
    """Box pairs of the next depth inside ``pairs``; with ``points`` every distinct place is a box of its own."""
    part = lambda d: {c: F.floor(F.col(f) * float(1 << (SPLIT_BITS * d))).cast("long") for c, f in (("_u", "_fx"), ("_v", "_fy"))}
    name = F.struct("_cx", "_cy", "_u", "_v")
    asked = pairs.select(*keys, F.explode(F.array("a", "b")).alias("_up")).distinct()
    inside = placed.withColumns(part(depth)).withColumn("_up", name).join(asked, [*keys, "_up"], "left_semi")
    inside = inside.withColumns(part(depth + 1)).withColumn("_name", name)
    boxes = inside.groupBy(*keys, "_up", "_name", *(["x", "y"] if points else [])).agg(*_box())
    ends = [boxes.select(*keys, F.col("_up").alias(old), F.col("_name").alias(f"_new{old}"), F.col("_b").alias(f"_b{old}"))
            for old in ("a", "b")]
    both = pairs.select(*keys, "a", "b").join(ends[0], [*keys, "a"]).join(ends[1], [*keys, "b"])
    return both.select(*keys, F.col("_newa").alias("a"), F.col("_newb").alias("b"), "_ba", "_bb")
