"""Connected components of linked pairs by contraction."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.scratch import stored
from fleetweave.session import is_empty

HELD = 1 << 20  # nodes a task keeps in mind
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the same nodes with far fewer links.

    Each task passes on only pairs whose ends it has not yet seen connected, so a dense group leaves it as a tree. Beyond
    ``HELD`` nodes a task starts to remember anew, which keeps more pairs and loses none.
    """
    def run(batches):
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(above) > HELD:
                    above.clear()
                low, high = sorted((top(a), top(b)))
                if low != high:
                    above[high] = low
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)] if kept else
                                             [pa.array([], pa.int64())] * 2, schema=_PAIR)

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs(a, b)``; connected nodes share a root, one of them.

    Each round hooks every node to its smallest neighbour, jumps twice along the hooks, and renames the ends of all pairs.
    Pairs inside one root go, so the graph shrinks by half or more a round. Rounds are tables in the shared folder.
    """
    pairs = stored(forest(pairs))
    levels = []
    while not is_empty(pairs):
        ends = pairs.union(pairs.select("b", "a")).toDF("node", "other")
        hooks = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root"))
        for _ in range(2):
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hooks = hooks.join(above, "root").select("node", F.col("up").alias("root"))
        hooks = stored(hooks)
        levels.append(hooks)
        renamed = (pairs.join(hooks.toDF("a", "x"), "a").join(hooks.toDF("b", "y"), "b").where("x <> y")
                   .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        pairs = stored(forest(renamed))
    if not levels:
        return pairs.toDF("node", "root")
    found = levels[0]
    for later in levels[1:]:
        found = (found.join(later.toDF("root", "next"), "root", "left")
                 .select("node", F.coalesce("next", "root").alias("root")))
    return found
