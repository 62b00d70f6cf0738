"""Convergence of a run's mean similarity over its monitor cycles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.operators import scan

RUN = ["run_id"]
MIN_RISE, EPS, STABLE_CYCLES = 0.03, 0.005, 3


def _calm(now: Column, before: Column, eps: float) -> Column:
    return before.isNotNull() & (F.abs(now - before) < eps)


def judged(cycles: DataFrame, order: str, chunk: Column, min_rise: float = MIN_RISE, eps: float = EPS,
           stable_cycles: int = STABLE_CYCLES, entry: DataFrame | None = None) -> DataFrame:
    """All that is known of every reading, in one pass over chunks of each run's history.

    A chunk is summed up as what it does to a run that enters it: with the reading before it and the readings in a row
    that stood still so far, the summary gives both at its end, and whether the run converges inside. Summaries compose, so
    runs are judged over one row per chunk, and each row adds what its chunk inherits. ``entry(run_id, base, sim, calm,
    done)`` is what runs bring along from earlier batches. ``chunk`` must not decrease along ``order``.
    """
    rows = cycles.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*RUN, "_chunk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sim, place = F.col("mean_sim"), F.col("_i")
    rows = rows.withColumns({"_i": F.row_number().over(inside).cast("long"), "_before": F.lag("mean_sim").over(inside)})
    # the first reading of a chunk stands still or not by what lies before the chunk
    moved = (place > 1) & ~_calm(sim, F.col("_before"), eps)
    rows = rows.withColumn("_reset", F.max(F.when(moved, place)).over(upto))

    counted = F.col("merges") > 0 if "merges" in cycles.columns else F.lit(False)
    late = F.col("_reset").isNotNull() & (place - F.col("_reset") >= stable_cycles)
    # highest reading that may converge: after a reset inside, and before one from each place on that the entry may name
    best = [F.max(F.when(counted & late, sim)).alias("_after")]
    best += [F.max(F.when(counted & F.col("_reset").isNull() & (place >= t), sim)).alias(f"_from{t}") for t in range(1, stable_cycles + 2)]
    chunks = rows.groupBy(*RUN, "_chunk").agg(
        F.count("*").alias("_n"), F.max("_reset").alias("_last_reset"), F.min_by(F.struct("mean_sim"), order).alias("_first"),
        F.max_by(F.struct("mean_sim"), order).alias("_last"), *best)

    along = Window.partitionBy(*RUN).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    if entry is None:
        carried = chunks.withColumns({"base": F.lit(None).cast("double"), "sim": F.lit(None).cast("double"),
                                      "calm": F.lit(None).cast("long"), "done": F.lit(False)})
    else:
        carried = chunks.join(entry.select(*RUN, "base", "sim", "calm", "done"), RUN, "left")
    first = F.col("_first.mean_sim")
    carried = carried.withColumns({
        "baseline": F.coalesce("base", F.first(F.struct(first.alias("v"))).over(along)["v"]),
        "_prior": F.when(F.row_number().over(along) == 1, F.col("sim")).otherwise(F.lag(F.col("_last.mean_sim")).over(along)),
        "_rows": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    carried = carried.withColumn("_goes_on", _calm(first, F.col("_prior"), eps))
    ends = F.coalesce(F.col("_rows") + F.col("_last_reset"), F.when(~F.col("_goes_on"), F.col("_rows") + 1))
    carried = carried.withColumn("_ends", ends)
    # readings that stood still on entry: rows so far less the last reset among them
    still = F.col("_rows") - F.coalesce(F.last("_ends", ignorenulls=True).over(earlier), -F.coalesce("calm", F.lit(0)))
    carried = carried.withColumn("_still", F.when(F.col("_goes_on"), still).otherwise(F.lit(-1)))
    needed = F.greatest(F.lit(1), F.lit(stable_cycles) - F.col("_still")).cast("int")
    from_ = F.element_at(F.array(*[f"_from{t}" for t in range(1, stable_cycles + 2)]), needed)
    hit = F.greatest(F.col("_after"), from_) - F.col("baseline") >= min_rise
    carried = carried.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    carried = carried.withColumn("_done", F.coalesce("done", F.lit(False)) | F.coalesce(F.max("_hit").over(earlier), F.lit(False)))

    known = rows.join(carried.select(*RUN, "_chunk", "baseline", "_prior", "_still", "_done"), [*RUN, "_chunk"])
    prior = F.when(place == 1, F.col("_prior")).otherwise(F.col("_before"))
    known = known.withColumns({
        "has_prev": prior.isNotNull(), "delta": F.coalesce(sim - prior, F.lit(0.0)), "rise": sim - F.col("baseline"),
        "stable": F.coalesce(place - F.col("_reset"), F.col("_still") + place).cast("long")})
    own = F.coalesce(counted & (F.col("rise") >= min_rise) & (F.col("stable") >= stable_cycles), F.lit(False)).cast("long")
    known = known.withColumn("_own", own)
    so_far = F.sum("_own").over(upto)
    return known.withColumns({"newly_converged": ~F.col("_done") & (F.col("_own") == 1) & (so_far == 1),
                              "converged": F.col("_done") | (so_far > 0)}).select(
        *cycles.columns, "baseline", "has_prev", "delta", "rise", "stable", "newly_converged", "converged")


def with_rise(cycles: DataFrame) -> DataFrame:
    """Add baseline (first reading), has_prev, delta from the previous reading (0.0 at first) and rise."""
    return judged(cycles, "cycle", scan.by_number("cycle")).drop("stable", "newly_converged", "converged")


def with_stability(cycles: DataFrame, eps: float = EPS) -> DataFrame:
    """``with_rise`` plus ``stable``: readings in a row that moved by less than ``eps``; any other resets it to 0."""
    return judged(cycles, "cycle", scan.by_number("cycle"), eps=eps).drop("newly_converged", "converged")


def convergence(cycles: DataFrame, min_rise: float = MIN_RISE, eps: float = EPS, stable_cycles: int = STABLE_CYCLES) -> DataFrame:
    """Add ``newly_converged`` and the latch ``converged``, which includes the row that sets it.

    A run converges once it has merges, has risen by at least ``min_rise`` and stayed stable for ``stable_cycles``.
    """
    return judged(cycles, "cycle", scan.by_number("cycle"), min_rise, eps, stable_cycles)


def run_summary(cycles: DataFrame, min_rise: float = 0.03, eps: float = 0.005, stable_cycles: int = 3) -> DataFrame:
    """One row per run: baseline, peak, final reading and the cycle it converged at."""
    judged = convergence(cycles, min_rise, eps, stable_cycles)
    return judged.groupBy("run_id").agg(
        F.count("*").alias("n_cycles"), F.max("baseline").alias("baseline"), F.max("mean_sim").alias("peak"),
        F.max_by("mean_sim", "cycle").alias("final_sim"),
        F.min(F.when(F.col("newly_converged"), F.col("cycle"))).alias("converged_cycle"))


def trajectory_metrics(cycles: DataFrame, runs: DataFrame) -> DataFrame:
    """Peak, time to peak (earliest on ties), slope after the peak and final value: per run size and seed, per size,
    and overall.

    The slope is that of each run's readings after its peak, then averaged over runs.
    """
    top = cycles.groupBy("run_id").agg(
        F.max("mean_sim").alias("peak"), F.max_by("mean_sim", "cycle").alias("final_sim"),
        F.min_by("elapsed_sec", F.struct(-F.col("mean_sim"), F.col("cycle"))).alias("time_to_peak"))
    after = (cycles.join(top.select("run_id", "time_to_peak"), "run_id")
             .where(F.col("elapsed_sec") > F.col("time_to_peak")).groupBy("run_id")
             .agg(F.regr_slope("mean_sim", F.col("elapsed_sec").cast("double")).alias("post_peak_slope")))
    per_run = top.join(after, "run_id", "left").join(runs, "run_id")
    return (per_run.rollup("n_robots", "seed")
            .agg(F.count("*").alias("n_runs"), F.avg("peak").alias("peak"), F.avg("time_to_peak").alias("time_to_peak"),
                 F.avg("post_peak_slope").alias("post_peak_slope"), F.avg("final_sim").alias("final_sim")))


def duplicate_writers(df: DataFrame, key: list[str], writer: str) -> DataFrame:
    """Keys written by more than one server, whose readings are suspect."""
    return (df.groupBy(*key).agg(F.count_distinct(writer).alias("n_writers"))
            .withColumn("suspect", F.col("n_writers") > 1))
