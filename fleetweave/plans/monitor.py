"""Monitor cycles: mean similarity, convergence verdict and exports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import labels
from fleetweave.operators import convergence, merging, similarity
from fleetweave.params import Params
from fleetweave.session import cut_lineage


def monitor_cycles(beliefs: DataFrame, merges: DataFrame, params: Params = Params()) -> DataFrame:
    """Judge every cycle of every run.

    ``beliefs(run_id, cycle, elapsed_sec, robot_id, z)`` holds the fleet's vectors per cycle, ``merges(run_id, cycle,
    n)`` the merges in it. A cycle without beliefs, like a failed reading, has no row.
    """
    means = cut_lineage(similarity.mean_similarity(beliefs, ["run_id", "cycle", "elapsed_sec"]))
    counts = merging.running_merges(means, merges)
    cycles = cut_lineage(means.join(counts, ["run_id", "cycle"]))
    return convergence.convergence(cycles, params.min_rise, params.stability_eps, params.stable_cycles)


def merge_cycles(receivers: DataFrame, starts: DataFrame, cycle_sec: int) -> DataFrame:
    """Shares heard per (run, cycle, sender, receiver); cycles count whole seconds from ``starts(run_id, start)``."""
    cycle = F.floor(labels.elapsed_sec("ts", "start") / cycle_sec).cast("int")
    return (receivers.join(starts, "run_id").withColumn("cycle", cycle)
            .groupBy("run_id", "cycle", "sender_id", "receiver_id").agg(F.count("*").alias("n")))
