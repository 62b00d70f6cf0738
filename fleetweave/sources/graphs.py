"""Choosing which graph each agent starts from."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.operators import scan


def assign_graphs(agents: DataFrame, graphs: DataFrame) -> DataFrame:
    """Graph number ``ds_idx`` (in graph_id order, wrapping past the end) for each agent."""
    numbered = scan.ranked(graphs.select("graph_id"), [], ["graph_id"], "_rank")
    total = graphs.agg(F.count("*").alias("_total"))
    indexed = numbered.select("graph_id", (F.col("_rank") - 1).alias("_idx"))
    # The one-row total is the only thing paired with every agent.
    count = total.first()["_total"]
    return (agents.withColumn("_idx", F.col("ds_idx") % F.lit(count)).join(indexed, "_idx").drop("_idx"))


def sample_graphs(graphs: DataFrame, k: int, seed: int = -1) -> DataFrame:
    """``k`` graphs by seeded hash order, the same however the data is partitioned; -1 draws a fresh seed.

    A bottom-k sample: the graphs of the ``k`` smallest hashes, md5 of ``id:seed``, which any engine can repeat. Bottom-k
    samples merge, so every task passes on ``k`` graphs at most. A graph that is listed twice is one graph.
    """
    salt = random.getrandbits(62) if seed < 0 else seed
    text = F.concat(F.col("graph_id").cast("string"), F.lit(f":{salt}"))
    hashed = graphs.select("graph_id").distinct().select(F.substring(F.md5(text), 1, 15).alias("_h"), "graph_id")
    return hashed.orderBy("_h", "graph_id").limit(k).select("graph_id")
