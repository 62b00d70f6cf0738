"""Connected components by label hooking and pointer jumping, each round cut off by a table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.session import forget, is_empty, written


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Label every node with the smallest node id of its component: (keys, node, component).

    ``nodes(keys, node)``, ``edges(keys, a, b)`` undirected. Each round takes the smallest grandparent label among the
    neighbours, hooks it to the node and to the node's parent, then jumps pointers, so long chains shrink
    exponentially. All exchanges are equi-joins and map-side combined minima.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = (edges.where("a <> b").select(*keys, ends.alias("_e"))
             .select(*keys, F.col("_e.a").alias("node"), F.col("_e.b").alias("_other")))
    links = written(links)

    lowest = links.groupBy(*keys, "node").agg(F.min("_other").alias("_low"))
    parents = nodes.select(*keys, "node").distinct().join(lowest, [*keys, "node"], "left")
    state = _jump(parents.select(*keys, "node", F.least("node", "_low").alias("_up")), keys)
    state = written(state.withColumn("_moved", F.lit(True)))
    while not is_empty(state.where("_moved")):
        around = (links.join(state.select(*keys, F.col("node").alias("_other"), "_top"), [*keys, "_other"])
                  .groupBy(*keys, "node").agg(F.min("_top").alias("_low")))
        offers = F.explode(F.array(F.col("node"), F.col("_up")))
        hooks = (state.join(around, [*keys, "node"]).where(F.col("_low") < F.col("_up"))
                 .select(*keys, offers.alias("node"), "_low").groupBy(*keys, "node").agg(F.min("_low").alias("_hook")))
        hooked = (state.join(hooks, [*keys, "node"], "left")
                  .select(*keys, "node", F.least("_up", "_top", "_hook").alias("_new"), F.col("_up").alias("_old_up"),
                          F.col("_top").alias("_old_top")).withColumnRenamed("_new", "_up"))
        moved = (F.col("_up") != F.col("_old_up")) | (F.col("_top") != F.col("_old_top"))
        before, state = state, written(_jump(hooked, keys).withColumn("_moved", moved).drop("_old_up", "_old_top"))
        forget(before)
    forget(links)
    return state.select(*keys, "node", F.col("_up").alias("component"))


def _jump(state: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_top``, the parent's parent."""
    above = state.select(*keys, F.col("node").alias("_up"), F.col("_up").alias("_top"))
    return state.join(above, [*keys, "_up"])
