"""Per-cycle CSV export, report text and visualisation tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import labels
from fleetweave.operators import scan
from fleetweave.operators.proximity import in_range_pairs

CYCLE = ["run_id", "cycle"]


def gathered(pair_counts: DataFrame) -> DataFrame:
    """All pair counts of each cycle in one array, which is as long as the run has pairs."""
    pair = F.struct(F.col("sender_id").alias("a"), F.col("receiver_id").alias("b"), F.col("n_merges").alias("c"))
    return pair_counts.groupBy(*CYCLE).agg(F.collect_list(pair).alias("pairs"))


def cycle_rows(cycles: DataFrame, positions: DataFrame, pair_counts: DataFrame, robot_ids: list[int]) -> DataFrame:
    """One wide row per cycle, with two columns per robot of the fleet and all pair counts as text.

    ``cycles(run_id, cycle, ts, elapsed_sec, mean_sim, baseline, rise, converged)``, ``positions(run_id, cycle,
    robot_id, x, y)``, ``pair_counts(run_id, cycle, sender_id, receiver_id, n_merges)``.
    """
    spots = (positions.where(F.col("robot_id").isin(robot_ids)).groupBy(*CYCLE)
             .pivot("robot_id", robot_ids).agg(F.first("x").alias("x"), F.first("y").alias("y")))
    places = [F.col(f"{i}_{axis}").alias(f"robot{i}_{axis}") for i in robot_ids for axis in "xy"]
    flag = F.when(F.col("converged"), "True").otherwise("False")
    return (cycles.join(spots, CYCLE, "left").join(gathered(pair_counts), CYCLE, "left")
            .select("run_id", "cycle", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "elapsed_sec",
                    "mean_sim", "baseline", "rise", flag.alias("converged"), *places,
                    F.coalesce(labels.format_pairs("pairs"), F.lit("")).alias("pair_counts")))


def write_cycle_csv(cycles: DataFrame, positions: DataFrame, pair_counts: DataFrame, robot_ids: list[int],
                    path: str) -> None:
    """Write ``cycle_rows`` as CSV with a header, one folder per run; an empty path writes nothing.

    Rows are range-partitioned, so a long run spans several files whose names follow its cycles.
    """
    if path:
        (cycle_rows(cycles, positions, pair_counts, robot_ids).repartitionByRange(*CYCLE)
         .sortWithinPartitions(*CYCLE).drop("cycle").write.partitionBy("run_id").mode("overwrite")
         .csv(path, header=True, nullValue="", emptyValue=""))


def cycle_report(judged: DataFrame, min_rise: float = 0.03, stable_cycles: int = 3) -> DataFrame:
    """Report text per cycle; ``judged`` as from ``convergence``, optionally with an array ``pairs``."""
    pairs = F.col("pairs") if "pairs" in judged.columns else F.lit(None).cast("array<struct<a:int,b:int,c:bigint>>")
    status = F.when(F.col("converged"), labels.STATUS_DONE).otherwise(labels.STATUS_OPEN)
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("[Monitor  t="), F.format_string("%03d", "elapsed_sec"), F.lit("s]  Mean pairwise sim: "),
                 labels.fixed("mean_sim", 4)),
        F.concat(F.lit("  Δ from last:  "), labels.fixed("delta", 4, sign=True), F.lit("   Trend: "),
                 labels.trend("delta")),
        F.concat(F.lit("  Active pairs: "), labels.format_active_pairs(pairs)),
        F.concat(F.lit("  Baseline: "), labels.fixed("baseline", 4), F.lit("   Rise: "),
                 labels.fixed("rise", 4, sign=True), F.lit(f" (min {min_rise})   Stable: "),
                 F.col("stable").cast("string"), F.lit(f"/{stable_cycles}")),
        F.concat(F.lit("  Status: "), status))
    return judged.select(*CYCLE, labels.trend("delta").alias("trend"), lines.alias("report"))


def final_report(judged: DataFrame, report: DataFrame) -> DataFrame:
    """Lines of the report of each converged run: head lines, one line per pair, the total.

    ``report`` as from ``merge_report``; ``line`` orders the text.
    """
    done = judged.where("newly_converged")
    head = F.array(
        F.concat(F.lit("CONVERGENCE REACHED at t="), F.col("elapsed_sec").cast("string"), F.lit("s")),
        F.concat(F.lit("  Final mean pairwise similarity: "), labels.fixed("mean_sim", 4)),
        F.concat(F.lit("  Rise over baseline: "), labels.fixed("rise", 4, sign=True)), F.lit("  Merge events:"))
    none = F.lit(-1)
    top = done.select("run_id", F.posexplode(head).alias("line", "text")).withColumns({"a": none, "b": none})
    pair = F.concat(F.lit("    Robot "), F.col("sender_id").cast("string"), F.lit(" → Robot "),
                    F.col("receiver_id").cast("string"), F.lit(": "), F.col("n_merges").cast("string"), F.lit(" merges"))
    total = F.concat(F.lit("  Total merge events: "), F.col("n_merges").cast("string"))
    body = report.join(done.select("run_id"), "run_id", "left_semi").select(
        "run_id", F.when(F.col("is_total"), 5).otherwise(4).alias("line"),
        F.when(F.col("is_total"), total).otherwise(pair).alias("text"),
        F.coalesce("sender_id", none).alias("a"), F.coalesce("receiver_id", none).alias("b"))
    return top.unionByName(body)


def _numbered(df: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    return scan.running(df, ["run_id"], order, chunk, total={"_rank": F.lit(1).cast("long")})


def marker_tables(positions: DataFrame, row_means: DataFrame, cycles: DataFrame, comm_range: float = 3.0) -> DataFrame:
    """Everything a viewer draws for each run, as one table.

    ``positions(run_id, robot_id, x, y)``, ``row_means(run_id, robot_id, row_mean)`` and ``cycles(run_id, cycle,
    mean_sim)``. Per run: a disc and a label for each placed robot, a line for each pair in range, a banner with the
    newest mean. Ids count through these in that order.
    """
    placed = positions.where(F.col("x").isNotNull())
    robots = _numbered(placed.join(row_means, ["run_id", "robot_id"], "left")
                       .withColumn("row_mean", F.coalesce("row_mean", F.lit(0.0))),
                       ["robot_id"], scan.by_number("robot_id"))
    colour = labels.sim_colour("row_mean")
    first = (F.col("_rank") - 1) * 2
    discs = robots.select("run_id", F.lit("robots").alias("ns"), first.alias("id"), "x", "y", F.lit(0.05).alias("z"),
                          F.lit(0.3).alias("scale"), colour["r"].alias("r"), colour["g"].alias("g"), colour["b"].alias("b"),
                          F.lit(0.85).alias("alpha"))
    white, grey = F.lit(1.0), F.lit(0.5)
    texts = robots.select("run_id", F.lit("labels").alias("ns"), (first + 1).alias("id"), "x", "y", F.lit(0.3).alias("z"),
                          F.lit(0.25).alias("scale"), white.alias("r"), white.alias("g"), white.alias("b"),
                          F.lit(1.0).alias("alpha"), labels.robot_label("robot_id", "row_mean").alias("text"))
    n_robots = placed.groupBy("run_id").agg((F.count("*") * 2).alias("_robots"))
    pairs = in_range_pairs(placed, comm_range)
    spot = lambda end: placed.select("run_id", F.col("robot_id").alias(end), F.struct("x", "y").alias(f"_{end}"))
    ends = pairs.join(spot("i"), ["run_id", "i"]).join(spot("j"), ["run_id", "j"])
    links = _numbered(ends, ["i", "j"], scan.by_number("i", 256)).join(n_robots, "run_id")
    lines = links.select("run_id", F.lit("comm_links").alias("ns"), (F.col("_robots") + F.col("_rank") - 1).alias("id"),
                         F.col("_i.x").alias("x"), F.col("_i.y").alias("y"), F.lit(0.05).alias("z"),
                         F.lit(0.02).alias("scale"), grey.alias("r"), grey.alias("g"), white.alias("b"),
                         F.lit(0.6).alias("alpha"), F.col("_j.x").alias("x2"), F.col("_j.y").alias("y2"))
    n_links = pairs.groupBy("run_id").agg(F.count("*").alias("_links"))
    newest = cycles.groupBy("run_id").agg(F.max_by("mean_sim", "cycle").alias("_mean"))
    zero = F.lit(0).cast("long")
    banner = (newest.join(n_robots, "run_id", "left").join(n_links, "run_id", "left")
              .select("run_id", F.lit("hud").alias("ns"),
                      (F.coalesce("_robots", zero) + F.coalesce("_links", zero)).alias("id"), F.lit(0.0).alias("x"),
                      F.lit(11.0).alias("y"), F.lit(0.5).alias("z"), F.lit(0.5).alias("scale"), white.alias("r"),
                      white.alias("g"), F.lit(0.0).alias("b"), F.lit(1.0).alias("alpha"),
                      labels.banner_label("_mean").alias("text")))
    out = lines
    for part in (discs, texts, banner):
        out = out.unionByName(part, allowMissingColumns=True)
    return out
