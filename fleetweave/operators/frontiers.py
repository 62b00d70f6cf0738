"""Occupancy grids: frontier cells, clusters of them, and their centroids."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.geometry import cell_to_world
from fleetweave.operators.components import components
from fleetweave.params import MIN_CLUSTER, OCCUPIED_FROM, UNKNOWN_CELL

MAP = ["map_id", "seq"]


def grid_cells(grids: DataFrame) -> DataFrame:
    """One row per cell of row-major grids."""
    flat = grids.select(*MAP, "width", F.posexplode("data").alias("cell", "v"))
    return flat.select(*MAP, F.col("cell").cast("long").alias("cell"), (F.col("cell") % F.col("width")).alias("x"),
                       F.floor(F.col("cell") / F.col("width")).cast("int").alias("y"), F.col("v").cast("int").alias("v"))


def frontier_cells(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Free cells off the one-cell border with an unknown 4-neighbour, from the long cell table."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    beside = (cells.where(F.col("v") == UNKNOWN_CELL).withColumn("_s", steps)
              .select(*MAP, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("y") + F.col("_s.j")).alias("y")))
    free = cells.where((F.col("v") >= 0) & (F.col("v") < OCCUPIED_FROM)).join(grids.select(*MAP, "width", "height"), MAP)
    inner = free.where("x >= 1 and x < width - 1 and y >= 1 and y < height - 1")
    return inner.join(beside, [*MAP, "x", "y"], "left_semi").select(*MAP, "cell", "x", "y")


def grid_frontier(grids: DataFrame) -> DataFrame:
    """``frontier_cells`` straight from the grid arrays: no shuffle, and only frontier cells are exploded."""
    w, h, data = F.col("width"), F.col("height"), F.col("data")

    def is_frontier(i):
        here, x, y = F.get(data, i), i % w, F.floor(i / w)
        inner = (x >= 1) & (x < w - 1) & (y >= 1) & (y < h - 1)
        free = (here >= 0) & (here < OCCUPIED_FROM)
        open_side = ((F.get(data, i - 1) == UNKNOWN_CELL) | (F.get(data, i + 1) == UNKNOWN_CELL)
                     | (F.get(data, i - w) == UNKNOWN_CELL) | (F.get(data, i + w) == UNKNOWN_CELL))
        return inner & free & open_side

    big_enough = grids.where("width >= 3 and height >= 3")
    found = F.filter(F.sequence(F.lit(0), F.size(data) - 1), is_frontier)
    flat = big_enough.select(*MAP, "width", F.explode(found).alias("cell"))
    return flat.select(*MAP, F.col("cell").cast("long").alias("cell"), (F.col("cell") % F.col("width")).alias("x"),
                       F.floor(F.col("cell") / F.col("width")).cast("int").alias("y"))


def frontier_clusters(frontier: DataFrame) -> DataFrame:
    """8-connected clusters; a cluster's id is its smallest linear cell index."""
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))]))
    reach = (frontier.withColumn("_s", ahead)
             .select(*MAP, F.col("cell").alias("a"), (F.col("x") + F.col("_s.i")).alias("x"),
                     (F.col("y") + F.col("_s.j")).alias("y")))
    touching = reach.join(frontier.withColumnRenamed("cell", "b"), [*MAP, "x", "y"]).select(*MAP, "a", "b")
    labels = components(frontier.select(*MAP, F.col("cell").alias("node")), touching, MAP)
    return (frontier.join(labels.withColumnRenamed("node", "cell"), [*MAP, "cell"])
            .withColumnRenamed("component", "cluster_id"))


def cluster_centroids(labelled: DataFrame, grids: DataFrame, min_cells: int = MIN_CLUSTER) -> DataFrame:
    """World centroid and size of each cluster of at least ``min_cells`` cells."""
    sized = (labelled.groupBy(*MAP, "cluster_id").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"),
                                                      F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells))
    frame = grids.select(*MAP, "resolution", "origin_x", "origin_y")
    return sized.join(frame, MAP).select(*MAP, "cluster_id", "n_cells",
                                         cell_to_world("origin_x", "_x", "resolution").alias("tx"),
                                         cell_to_world("origin_y", "_y", "resolution").alias("ty"))
