"""Contact-graph fragmentation: components, connectivity over time, similarity within and between clusters."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.vectors import dot, doubles, unit
from fleetweave.operators.components import components
from fleetweave.session import cut_lineage, is_empty


def contact_components(pairs: DataFrame, robots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Component of each robot per ``by`` group; a robot without contact is its own component and isolated."""
    by = ["run_id"] if by is None else by
    found = components(robots.select(*by, F.col("robot_id").alias("node")),
                       pairs.select(*by, F.col("i").alias("a"), F.col("j").alias("b")), by)
    found = found.withColumnRenamed("node", "robot_id")
    sizes = found.groupBy(*by, "component").agg(F.count("*").alias("n_members"))
    return found.join(sizes, [*by, "component"]).withColumn("isolated", F.col("n_members") == 1)


def first_contact_forest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, t): the contacts that join parts of a fleet for the first time, a minimum spanning forest by time.

    ``pairs(keys, i, j, t)``. Borůvka rounds: every part takes its earliest contact with another part, ties by (i, j), and
    parts that these contacts join become one. Parts at least halve, so rounds are logarithmic in the number of robots.
    """
    firsts = cut_lineage(pairs.where("i <> j").groupBy(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
                         .agg(F.min("t").alias("t")))
    links = firsts.select(*keys, "i", "j", "t", F.col("i").alias("a"), F.col("j").alias("b"))
    chosen = None
    while not is_empty(links):
        ends = links.select(*keys, F.struct("t", "i", "j").alias("_c"), F.explode(F.array("a", "b")).alias("part"))
        taken = ends.groupBy(*keys, "part").agg(F.min("_c").alias("_c")).select(*keys, "_c.i", "_c.j", "_c.t").distinct()
        taken = cut_lineage(taken)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        joined = links.join(taken.select(*keys, "i", "j"), [*keys, "i", "j"], "left_semi").select(*keys, "a", "b")
        parts = links.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
        names = components(parts, joined, keys)
        left, right = (names.select(*keys, F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("a", "b"))
        links = cut_lineage(links.join(left, [*keys, "a"]).join(right, [*keys, "b"]).where("_a <> _b")
                            .select(*keys, "i", "j", "t", F.col("_a").alias("a"), F.col("_b").alias("b")))
    return firsts.where("false") if chosen is None else chosen


def union_connectivity(pairs: DataFrame, robots: DataFrame, at_times: list) -> DataFrame:
    """Whether the union of all contacts up to each time connects the whole fleet of a run.

    ``pairs(run_id, i, j, t)``. One forest serves any number of times: every contact of it that has come joins two parts,
    so the number of parts is that of robots less those contacts.
    """
    run = ["run_id"]
    forest = first_contact_forest(pairs, run)
    times = F.explode(F.array(*[F.lit(t) for t in at_times])).alias("at")
    fleet = robots.select(*run, "robot_id").distinct().groupBy(*run).agg(F.count("*").alias("_robots")).select(*run, "_robots", times)
    joined = forest.select(*run, "t").join(fleet, run).where("t <= at").groupBy(*run, "at").agg(F.count("*").alias("_joined"))
    counted = fleet.join(joined, [*run, "at"], "left").withColumn("n_components", F.col("_robots") - F.coalesce("_joined", F.lit(0)))
    return counted.select(*run, "at", "n_components", (F.col("n_components") == 1).alias("connected"))


def cluster_similarity(agents: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean cosine within and between components, from per-component vector sums; 0.0 where there are no pairs."""
    by = ["run_id"] if by is None else by
    units = agents.withColumn("_u", unit(doubles("z"))).withColumn("_sq", dot("_u", "_u"))
    joined = units.join(labels.select(*by, "robot_id", "component"), [*by, "robot_id"])
    flat = joined.select(*by, "component", "_sq", F.posexplode("_u").alias("_k", "_v"))
    parts = (flat.groupBy(*by, "component", "_k")
             .agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"), F.sum("_sq").alias("_q")))
    axes = parts.groupBy(*by, "_k").agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_inner"), F.sum("_s").alias("_sum"), F.sum("_q").alias("_q"),
        F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_pairs"), F.sum("_n").alias("_n"), F.count("*").alias("_parts"))
    sums = axes.groupBy(*by).agg(
        (F.sum("_inner") - F.max("_q")).alias("_in"), (F.sum(F.col("_sum") * F.col("_sum")) - F.max("_q")).alias("_all"),
        F.max("_pairs").alias("_in_pairs"), F.max("_n").alias("_n"), F.max("_parts").alias("n_components"))
    between = F.col("_n") * (F.col("_n") - 1) - F.col("_in_pairs")
    return sums.select(
        *by, "n_components",
        F.when(F.col("_in_pairs") > 0, F.col("_in") / F.col("_in_pairs")).otherwise(0.0).alias("within_sim"),
        F.when(between > 0, (F.col("_all") - F.col("_in")) / between).otherwise(0.0).alias("between_sim"))
