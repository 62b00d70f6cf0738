"""Every operator as a query over the test tables; results carry rounded doubles and microsecond times."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.functions import geometry, labels, vectors
from fleetweave.operators import (convergence, fragmentation, frontiers, goals, knowledge, merging, motion, proximity,
                                  scan, similarity)
from fleetweave.operators.contact_links import contact_links
from fleetweave.plans import frontier_targets, monitor, sharing_round
from fleetweave.sinks import rejects, reports
from fleetweave.sources import fixtures as fx
from fleetweave.sources import graphs, messages
from fleetweave.session import cut_lineage, written
from fleetweave.streaming import batches, stateless

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HOUR = 3600.0
RAW_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
ROBOT_IDS = list(range(10))  # the fleet, which decides the columns of the CSV export


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(value) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def us(ts="ts") -> Column:
    return scan.micros(ts)


def sim_of_value() -> Column:
    """A similarity-like number in [-1, 1] out of an event value."""
    return F.col("value") / 245.01 - 1


def latest(spark, path) -> DataFrame:
    return proximity.latest_positions(fx.world(spark, path))


def cycle_positions(spark, path) -> DataFrame:
    """Everyone's position at the end of every hour of its run; robots not seen yet are left out."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("cycle")
    end = F.to_timestamp("run_id") + F.make_dt_interval(hours=F.col("cycle") + 1)
    at = fx.fleet(spark, path).select("run_id", "robot_id", hours).withColumn("ts", end)
    return proximity.positions_asof(fx.world(spark, path), at).where(F.col("x").isNotNull())


def cycle_pairs(spark, path, directed=False) -> DataFrame:
    return proximity.in_range_pairs(cycle_positions(spark, path), 3.0, directed, ["run_id", "cycle"])


def good_shares(spark, path) -> DataFrame:
    return messages.read_shares(fx.kg_share(spark, path))[0]


def receivers(spark, path) -> DataFrame:
    return proximity.share_receivers(good_shares(spark, path), fx.world(spark, path), 3.0, HOUR)


def cycle_merges(spark, path) -> DataFrame:
    heard = receivers(spark, path)
    starts = fx.fleet(spark, path).select("run_id").distinct().withColumn("start", F.to_timestamp("run_id"))
    return monitor.merge_cycles(heard, starts, 3600)


def judged(spark, path) -> DataFrame:
    return convergence.convergence(fx.cycles(spark, path))


def running_pairs(spark, path) -> DataFrame:
    """Every pair that has merged so far with its count, per cycle of its run."""
    return merging.running_pairs(fx.cycles(spark, path), cycle_merges(spark, path))


def targets(spark, path) -> DataFrame:
    grids = fx.grids(spark, path)
    labelled = frontiers.frontier_clusters(frontiers.grid_frontier(grids))
    return frontiers.cluster_centroids(labelled, grids)


def blacklist(spark, path) -> DataFrame:
    """One banned point per map, 0.3 m right and up of its origin."""
    return fx.grids(spark, path).select("map_id", "seq", (F.col("origin_x") + 0.3).alias("bx"),
                                        (F.col("origin_y") + 0.3).alias("by"))


def map_robots(spark, path) -> DataFrame:
    """One robot per map, at its origin."""
    return fx.grids(spark, path).select("map_id", "seq", F.col("map_id").alias("robot_id"),
                                        F.col("origin_x").alias("x"), F.col("origin_y").alias("y"))


def map_updates(spark, path) -> DataFrame:
    """Map arrivals per robot: one per order line."""
    ts = F.timestamp_micros(us(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") * 1000000)
    return fx.table(spark, path, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("robot_id"), ts.alias("ts"))


def events_stream(spark, path) -> DataFrame:
    """The event table as a stream of shaped telemetry in world coordinates."""
    fx.configure(spark)
    raw = messages.read_telemetry(spark, fx.stream_path(path, "events"), stream=True, schema=RAW_EVENTS)
    return proximity.to_world(fx.shape_events(raw), fx.robots(spark, path))


# Sources and sinks

@query
def telemetry_source(spark, path):
    fx.configure(spark)
    raw = messages.read_telemetry(spark, f"{path}/events.parquet", schema=RAW_EVENTS)
    return rounded(fx.shape_events(raw).select("run_id", "robot_id", "event_id", us().alias("us"), "odom_x", "odom_y",
                                               "qz", "qw", "cmd_speed"), "odom_x", "odom_y", "qz", "qw")


@query
def share_messages(spark, path):
    return good_shares(spark, path).select("run_id", "msg_id", us().alias("us"), "sender_id",
                                           F.col("graph.num_nodes").alias("num_nodes"))


@query
def share_rejects(spark, path):
    return messages.read_shares(fx.kg_share(spark, path))[1].select("run_id", "msg_id", "payload", "error")


@query
def share_filter(spark, path):
    """Parsed shares and possible receivers other than the sender, counted per run."""
    shares = good_shares(spark, path).groupBy("run_id", "sender_id").agg(F.count("*").alias("n_shares"))
    others = fx.fleet(spark, path).groupBy("run_id").agg((F.count("*") - 1).alias("n_others"))
    return shares.join(others, "run_id")


@query
def grid_to_cells(spark, path):
    return frontiers.grid_cells(fx.grids(spark, path))


@query
def graph_assignment(spark, path):
    wanted = fx.vectors(spark, path).select("agent_id", (F.col("agent_id") * 900).alias("ds_idx"))
    catalogue = fx.table(spark, path, "part").select(F.col("p_partkey").alias("graph_id"))
    return graphs.assign_graphs(wanted, catalogue)


@query
def graph_sample(spark, path):
    fx.configure(spark)
    return graphs.sample_graphs(fx.table(spark, path, "part").select(F.col("p_partkey").alias("graph_id")), 50, 7)


@query
def cycle_csv_rows(spark, path):
    cycles = judged(spark, path).withColumn("ts", F.to_timestamp("run_id") + F.make_dt_interval(hours=F.col("cycle")))
    rows = reports.cycle_rows(cycles, cycle_positions(spark, path), running_pairs(spark, path), ROBOT_IDS)
    places = [f"robot{i}_{axis}" for i in ROBOT_IDS for axis in "xy"]
    return rounded(rows, "mean_sim", "baseline", "rise", *places)


@query
def convergence_feed(spark, path):
    """Publish the readings of a stream as single precision and read the table back."""
    out = batches.work_dir(spark)
    readings = events_stream(spark, path).select("run_id", "ts", (F.col("value") / 490.02).alias("mean_sim"))
    batches.publish_convergence(readings, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("run_id", us().alias("us"),
                                                     F.round(F.col("mean_sim").cast("double"), 4).alias("mean_sim"))


@query
def markers(spark, path):
    means = similarity.row_mean_similarity(fx.fleet_agents(spark, path))
    out = reports.marker_tables(latest(spark, path), means, fx.cycles(spark, path))
    return rounded(out, "x", "y", "x2", "y2", "r", "g")


@query
def request_verdicts(spark, path):
    """Service requests checked in-band: agents asked for, with the text of every failure."""
    asked = fx.telemetry(spark, path).select("event_id", "robot_id", "k", "value")
    checks = {"unknown agent": F.col("k") % 12 >= 10, "self merge": F.col("k") % 12 == F.col("robot_id"),
              "weight out of range": F.col("value") > 400}
    return rejects.with_verdict(asked, checks).select("event_id", "ok", "error")


# Projections

@query
def world_positions(spark, path):
    return rounded(fx.world(spark, path).select("run_id", "robot_id", "event_id", "x", "y"), "x", "y")


@query
def yaw(spark, path):
    return fx.telemetry(spark, path).select("event_id", r6(geometry.yaw("qx", "qy", "qz", "qw")).alias("yaw"))


@query
def peer_distance(spark, path):
    """Distance of each robot to the one with the next id at the end of the run; 999 where that one is unknown."""
    here = latest(spark, path).select("run_id", "robot_id", "x", "y")
    peer = here.select("run_id", (F.col("robot_id") - 1).alias("robot_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    dist = geometry.distance_or_unknown("x", "y", "px", "py")
    return here.join(peer, ["run_id", "robot_id"], "left").select("run_id", "robot_id", r6(dist).alias("dist"))


@query
def heading_error(spark, path):
    to_centre = F.atan2(-F.col("y"), -F.col("x"))
    diff = geometry.angle_diff(to_centre, geometry.yaw("qx", "qy", "qz", "qw"))
    return fx.world(spark, path).select("event_id", r6(F.abs(diff)).alias("heading_error"))


@query
def wall_proximity(spark, path):
    return fx.world(spark, path).select("event_id", geometry.near_wall("x", "y").alias("near_wall"))


@query
def retention_bands(spark, path):
    return fx.telemetry(spark, path).select("event_id", r6(sim_of_value()).alias("sim"),
                                            labels.retention_band(sim_of_value()).alias("retention"))


@query
def trends(spark, path):
    return convergence.with_rise(fx.cycles(spark, path)).select("run_id", "cycle", labels.trend("delta").alias("trend"))


@query
def similarity_colours(spark, path):
    colour = labels.sim_colour(sim_of_value())
    return fx.telemetry(spark, path).select("event_id", r6(colour["r"]).alias("r"), r6(colour["g"]).alias("g"),
                                            colour["b"].alias("b"))


@query
def cycle_reports(spark, path):
    pairs = reports.gathered(running_pairs(spark, path))
    return reports.cycle_report(judged(spark, path).join(pairs, ["run_id", "cycle"], "left"))


@query
def final_reports(spark, path):
    """The report that each run's converging cycle writes, with the merges up to that cycle."""
    found = judged(spark, path)
    until = found.where("newly_converged").select("run_id", F.col("cycle").alias("_until"))
    counts = cycle_merges(spark, path).join(until, "run_id").where("cycle <= _until").withColumnRenamed("n", "n_merges")
    return reports.final_report(found, merging.merge_report(counts))


@query
def vector_algebra(spark, path):
    first = fx.agents(spark, path).select(F.col("agent_id").alias("label"), F.col("z").alias("z0"))
    both = fx.vectors(spark, path).join(first, "label")
    return both.select("agent_id", r6(vectors.dot("z", "z0")).alias("dot"), r6(vectors.l2("z")).alias("norm"),
                       r6(vectors.cosine("z", "z0")).alias("cosine"),
                       r6(F.element_at(vectors.unit(vectors.scale("z", 3.0)), 1)).alias("unit_1"))


@query
def cell_centres(spark, path):
    grids = fx.grids(spark, path)
    cells = frontiers.grid_cells(grids).join(grids.select("map_id", "seq", "resolution", "origin_x", "origin_y"), ["map_id", "seq"])
    return cells.select("map_id", "cell", r6(geometry.cell_to_world("origin_x", "x", "resolution")).alias("wx"),
                        r6(geometry.cell_to_world("origin_y", "y", "resolution")).alias("wy"))


@query
def projected_points(spark, path):
    p = geometry.project_out("x", "y", F.lit(0.0), F.lit(0.0))
    return fx.world(spark, path).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query
def pair_texts(spark, path):
    pairs = reports.gathered(running_pairs(spark, path))
    return fx.cycles(spark, path).join(pairs, ["run_id", "cycle"], "left").select(
        "run_id", "cycle", F.coalesce(labels.format_pairs("pairs"), F.lit("")).alias("csv_text"),
        labels.format_active_pairs("pairs").alias("report_text"))


@query
def cell_classes(spark, path):
    cells = frontiers.grid_cells(fx.grids(spark, path))
    return cells.groupBy("map_id", labels.cell_class("v").alias("class")).agg(F.count("*").alias("n"))


@query
def elapsed_seconds(spark, path):
    rows = fx.telemetry(spark, path)
    starts = rows.groupBy("run_id").agg(F.min("ts").alias("start"))
    return rows.join(starts, "run_id").select("event_id", labels.elapsed_sec("ts", "start").alias("elapsed_sec"))


# Joins

@query
def share_positions(spark, path):
    """Where every sender was when it shared."""
    at = good_shares(spark, path).withColumnRenamed("sender_id", "robot_id").select("run_id", "robot_id", "ts", "msg_id")
    found = proximity.positions_asof(fx.world(spark, path), at)
    return found.select("msg_id", "robot_id", r6("x").alias("x"), r6("y").alias("y"), us("seen_ts").alias("seen_us"))


@query
def pairs_in_range(spark, path):
    return rounded(proximity.in_range_pairs(latest(spark, path)), "dist")


@query
def share_fanout(spark, path):
    return rounded(receivers(spark, path).select("run_id", "msg_id", "sender_id", "receiver_id", "dist"), "dist")


@query
def similarity_matrix(spark, path):
    return rounded(similarity.pairwise_similarity(fx.vectors(spark, path), matrix_requests(spark, path))[0], "sim")


@query
def similarity_request_failures(spark, path):
    return similarity.pairwise_similarity(fx.vectors(spark, path), matrix_requests(spark, path))[1]


def matrix_requests(spark, path) -> DataFrame:
    """Each run asks for its ten agents, last first, then the first agent of the next run, which may not exist."""
    own = fx.vectors(spark, path).select(F.col("run_id").alias("request_id"), (9 - F.col("robot_id")).cast("long").alias("ord"),
                                         "agent_id")
    extra = own.select("request_id").distinct().select("request_id", F.lit(10).cast("long").alias("ord"),
                                                       (F.col("request_id") * 10 + 10).alias("agent_id"))
    return own.unionByName(extra)


@query
def usable_targets(spark, path):
    kept = goals.drop_blacklisted(targets(spark, path), blacklist(spark, path), ["map_id", "seq"],
                                  ["map_id", "seq", "cluster_id"])
    return rounded(kept.select("map_id", "cluster_id", "n_cells", "tx", "ty"), "tx", "ty")


@query
def frontier_cells(spark, path):
    return frontiers.grid_frontier(fx.grids(spark, path)).select("map_id", "cell", "x", "y")


@query
def frontier_cells_joined(spark, path):
    grids = fx.grids(spark, path)
    return frontiers.frontier_cells(frontiers.grid_cells(grids), grids).select("map_id", "cell", "x", "y")


@query
def every_robot(spark, path):
    """All robots of a run at six o'clock, placed or not."""
    fleet = fx.fleet(spark, path)
    at = fleet.withColumn("ts", F.to_timestamp("run_id") + F.expr("INTERVAL 6 HOURS"))
    known = proximity.positions_asof(fx.world(spark, path), at).where(F.col("x").isNotNull())
    out = proximity.all_robots(fleet, known.select("run_id", "robot_id", "x", "y"), ["run_id", "robot_id"])
    return rounded(out, "x", "y")


@query
def induced_edges(spark, path):
    """Edges whose ends both have degree at least three."""
    nodes, edges = fx.nodes(spark, path), written(fx.edges(spark, path))
    busy = knowledge.endpoints(edges).groupBy("graph_id", "node_id").count().where("count >= 3").select("graph_id", "node_id")
    return knowledge.induced_subgraph(nodes, edges, busy)[1].select("graph_id", "src", "dst", "etype")


@query
def peer_similarities(spark, path):
    pairs = proximity.in_range_pairs(latest(spark, path), directed=True)
    return rounded(similarity.peer_similarity(pairs, fx.fleet_agents(spark, path)).select("run_id", "i", "j", "sim"), "sim")


# Aggregations

@query
def merge_counts(spark, path):
    return merging.merge_counts(receivers(spark, path))


@query
def mean_similarity(spark, path):
    return rounded(similarity.mean_similarity(fx.vectors(spark, path)), "mean_sim")


@query
def mean_similarity_by_label(spark, path):
    return rounded(similarity.mean_similarity(fx.vectors(spark, path), ["label"]), "mean_sim")


@query
def row_mean_similarity(spark, path):
    found = similarity.row_mean_similarity(fx.vectors(spark, path))
    return rounded(found.select("run_id", "agent_id", "row_mean"), "row_mean")


@query
def peer_centroids(spark, path):
    here = latest(spark, path)
    pairs = proximity.in_range_pairs(here, directed=True)
    return rounded(proximity.peer_centroid(pairs, here), "cx", "cy")


@query
def share_retention(spark, path):
    pairs = proximity.in_range_pairs(latest(spark, path), directed=True)
    sims = similarity.peer_similarity(pairs, fx.fleet_agents(spark, path))
    return rounded(similarity.share_retention(sims), "min_sim")


@query
def merge_report(spark, path):
    return merging.merge_report(merging.merge_counts(receivers(spark, path)))


@query
def graph_statistics(spark, path):
    return knowledge.graph_stats(*trade_graphs(spark, path))


@query
def cluster_centroids(spark, path):
    return rounded(targets(spark, path).select("map_id", "cluster_id", "n_cells", "tx", "ty"), "tx", "ty")


@query
def trajectory_metrics(spark, path):
    found = convergence.trajectory_metrics(fx.cycles(spark, path), fx.runs(spark, path))
    found = found.withColumn("post_peak_slope", F.col("post_peak_slope") * 1000)
    return rounded(found, "peak", "time_to_peak", "post_peak_slope", "final_sim")


@query
def duplicate_writers(spark, path):
    """Servers (event types) seen per robot and hour."""
    rows = fx.telemetry(spark, path).withColumn("hour", F.hour("ts"))
    return convergence.duplicate_writers(rows, ["run_id", "robot_id", "hour"], "event_type")


@query
def merged_embeddings(spark, path):
    folded = merging.merge_embeddings(fx.agents(spark, path), fx.merge_events(spark, path))
    flat = folded.select("agent_id", "n_folded", F.posexplode("z").alias("pos", "z"))
    return rounded(flat, "z")


@query
def merge_request_failures(spark, path):
    """Merge requests that name no agent, or carry no vector, one of the wrong length, or one that is not all numbers."""
    seq = F.col("seq")
    vector = (F.when(seq % 13 == 0, F.lit(None)).when(seq % 7 == 0, F.slice("r", 1, 10))
              .when(seq % 17 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice("r", 2, 63))).otherwise(F.col("r")))
    receiver = F.when(seq % 11 == 0, F.col("receiver_id") + 100).otherwise(F.col("receiver_id"))
    events = fx.merge_events(spark, path).select(receiver.alias("receiver_id"), "seq", vector.alias("r"))
    found = merging.checked_merges(fx.agents(spark, path), events).where("error is not null")
    return found.select("seq", "receiver_id", F.lit(False).alias("ok"), "error")


@query
def merge_replies(spark, path):
    folded = merging.merge_embeddings(fx.agents(spark, path), fx.merge_events(spark, path))
    return merging.merge_reply(folded).select("agent_id", "gate", r6("z_norm").alias("z_norm"),
                                              r6(F.element_at("z_star", 1)).alias("z_first"))


@query
def share_traffic(spark, path):
    first = F.get(F.get("graph.x", F.lit(0)), F.lit(0)).cast("double")
    sent = good_shares(spark, path).withColumn("retention", labels.retention_band(first / 50.0 - 1))
    found = merging.share_traffic(sent, receivers(spark, path), "6 hours")
    return found.select("run_id", "robot_id", us("bucket").alias("bucket_us"), "broadcasts", "recipients", "bytes",
                        r6("mean_retention").alias("mean_retention"))


@query
def peers_in_range(spark, path):
    here = latest(spark, path)
    pages = proximity.peers_in_range(proximity.in_range_pairs(here, directed=True), here.select("run_id", "robot_id"))
    return pages.select("run_id", "robot_id", "n_peers", "page", F.array_join("peers", ",").alias("peers"))


@query
def exploration_progress(spark, path):
    return goals.exploration_progress(targets(spark, path), blacklist(spark, path), fx.grids(spark, path)).drop("seq")


# Windows

@query
def cycle_rise(spark, path):
    found = convergence.with_rise(fx.cycles(spark, path))
    return rounded(found.select("run_id", "cycle", "mean_sim", "baseline", "has_prev", "delta", "rise"),
                   "mean_sim", "baseline", "delta", "rise")


@query
def cycle_stability(spark, path):
    return convergence.with_stability(fx.cycles(spark, path)).select("run_id", "cycle", "stable")


@query
def cycle_convergence(spark, path):
    return judged(spark, path).select("run_id", "cycle", "merges", "stable", "newly_converged", "converged")


@query
def run_summary(spark, path):
    return rounded(convergence.run_summary(fx.cycles(spark, path)), "baseline", "peak", "final_sim")


def stuck_inputs(spark, path):
    """Samples and poses, ticks 45 minutes after every click or view, and clears at sign-ups."""
    rows = fx.world(spark, path)
    samples = rows.select("run_id", "robot_id", "ts", "event_id", "x", "y", F.col("cmd_speed").alias("speed"))
    later = F.timestamp_micros(us() + 2700 * 1000000)
    ticks = fx.of_type(rows, "click", "view").select("run_id", "robot_id", later.alias("ts"), "event_id")
    return samples, ticks, rows, fx.of_type(rows, "signup")


@query
def stuck_ticks(spark, path):
    samples, ticks, poses, clears = stuck_inputs(spark, path)
    found = motion.stuck(samples, ticks, poses, 4 * HOUR, 6.0, clears)
    return found.select("run_id", "robot_id", "event_id", "stuck")


@query
def stuck_triggers(spark, path):
    samples, ticks, poses, _ = stuck_inputs(spark, path)
    found = motion.stuck_triggers(motion.stuck(samples, ticks, poses, 4 * HOUR, 6.0))
    return found.select("run_id", "robot_id", "event_id")


@query
def escape_escalations(spark, path):
    """Consecutive triggers of a robot over the whole fleet history."""
    triggers = fx.of_type(fx.world(spark, path), "error").withColumn("run_id", F.lit("all"))
    found = motion.escalations(triggers, 5.0, 6 * HOUR)
    return rounded(found.select("robot_id", "event_id", "escalated", "reverse_m", "suppress_sec", "reverse_cap_sec"),
                   "reverse_m", "reverse_cap_sec")


@query
def suppressed_ticks(spark, path):
    rows = fx.world(spark, path)
    escapes = motion.escalations(fx.of_type(rows, "error"), 5.0, 6 * HOUR, suppress_sec=HOUR)
    found = motion.suppressed(fx.of_type(rows, "click", "view"), escapes)
    return found.select("run_id", "robot_id", "event_id", "suppressed")


@query
def behaviour_timeline(spark, path):
    rows = fx.world(spark, path)
    control = fx.of_type(rows, "purchase", "signup").withColumn(
        "control", F.when(F.col("event_type") == "purchase", "share").otherwise("exit"))
    found = motion.behaviour_timeline(fx.of_type(rows, "click", "view"), control, rows, 2 * HOUR, bucket_sec=HOUR)
    return found.select("run_id", "robot_id", "event_id", "state")


@query
def frozen_pairs(spark, path):
    found = motion.frozen_pairs(cycle_pairs(spark, path), 4, 0.01)
    return rounded(found, "dist", "spread")


@query
def isolated_robots(spark, path):
    here = cut_lineage(cycle_positions(spark, path))
    return motion.isolated_robots(here.select("run_id", "cycle", "robot_id"), contact_links(here, 3.0, ["run_id", "cycle"]), ["run_id", "cycle"])


@query
def goal_outcomes(spark, path):
    found = goals.goal_outcomes(fx.goal_log(spark, path))
    return found.select("robot_id", "goal_num", "outcome", "blacklisted")


@query
def goal_blacklist(spark, path):
    return rounded(goals.blacklist_points(goals.goal_outcomes(fx.goal_log(spark, path))), "bx", "by")


@query
def dispatch_gaps(spark, path):
    found = goals.dispatch_gaps(goals.goal_outcomes(fx.goal_log(spark, path)), 600.0)
    return rounded(found.select("robot_id", "goal_num", "gap_sec", "too_soon"), "gap_sec")


@query
def stale_maps(spark, path):
    found = goals.stale_maps(goals.goal_outcomes(fx.goal_log(spark, path)), map_updates(spark, path), 12 * HOUR)
    return found.select("robot_id", "goal_num", us("next_map").alias("next_us"), "stale")


@query
def carried_similarity(spark, path):
    """Known similarity per hour and peer, where a third of the refreshes failed."""
    beliefs = fx.fleet_agents(spark, path)
    sims = similarity.peer_similarity(cycle_pairs(spark, path, True), beliefs)
    lost = (F.col("cycle") + F.col("i") + F.col("j")) % 3 == 0
    when = F.to_timestamp("run_id") + F.make_dt_interval(hours=F.col("cycle"))
    read = sims.select("run_id", "i", "j", "cycle", when.alias("ts"), F.lit(0).cast("long").alias("event_id"),
                       F.when(~lost, F.col("sim") + F.col("cycle") / 100.0).alias("sim"))
    found = similarity.carry_similarity(read).select("run_id", "i", "j", "cycle", "known_sim")
    return rounded(found, "known_sim")


@query
def running_merges(spark, path):
    return merging.running_merges(fx.cycles(spark, path), cycle_merges(spark, path))


@query
def next_targets(spark, path):
    found = frontier_targets.frontier_targets(fx.grids(spark, path), map_robots(spark, path), blacklist(spark, path))
    return rounded(found.drop("seq"), "gx", "gy", "fx", "fy")


@query
def interleaved_clock(spark, path):
    rows = fx.world(spark, path)
    shares = good_shares(spark, path).select("run_id", "ts", F.col("msg_id").alias("event_id"), "sender_id")
    clock = proximity.interleave(rows.select("run_id", "ts", "event_id", "robot_id"), shares)
    return clock.select("run_id", us().alias("us"), "event_id", "kind", "robot_id", "sender_id")


# Graphs

@query
def graph_nodes(spark, path):
    nodes, _ = messages.explode_graphs(good_shares(spark, path))
    return nodes.select("graph_id", "node_id", r6(F.get("x", F.lit(0)).cast("double")).alias("x0"),
                        r6(F.get("x", F.lit(1)).cast("double")).alias("x1"))


@query
def graph_edges(spark, path):
    return messages.explode_graphs(good_shares(spark, path))[1]


@query
def packed_graphs(spark, path):
    return knowledge.pack_graphs(*messages.explode_graphs(good_shares(spark, path)))


def trade_graphs(spark, path) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written out once: compression reads them several times, as it would stored tables."""
    edges = written(fx.edges(spark, path))
    return written(fx.nodes_of(edges, spark, path)), edges


@query
def compressed_nodes(spark, path):
    marked = knowledge.keep_top(*trade_graphs(spark, path))
    return marked.select("graph_id", "node_id", "degree", "score", "rank", "kept")


@query
def compression_stats(spark, path):
    return rounded(knowledge.compress(*trade_graphs(spark, path))[2], "node_retention")


@query
def frontier_clusters(spark, path):
    labelled = frontiers.frontier_clusters(frontiers.grid_frontier(fx.grids(spark, path)))
    return labelled.select("map_id", "cell", "cluster_id")


@query
def explored_targets(spark, path):
    """Two robots on every map choose a target in the first days of the goal log: what a robot has tried by then rules out points for it.

    All maps lie in the frame of the goals, and robot k chooses on day k + 1.
    """
    grids, log = fx.grids(spark, path).withColumns({"origin_x": F.lit(0.0), "origin_y": F.lit(0.0)}), fx.goal_log(spark, path)
    first = log.agg(F.min("ts").alias("first"))  # one row
    pair = F.explode(F.array(*[((F.col("map_id") + k) % 10).cast("int") for k in (0, 5)])).alias("robot_id")
    robots = grids.select("map_id", "seq", pair, F.lit(0.2).alias("x"), F.lit(0.1).alias("y")).join(F.broadcast(first))
    robots = robots.withColumn("ts", F.col("first") + F.make_dt_interval(days=F.col("robot_id") + 1)).drop("first")
    found = frontier_targets.explored_targets(grids, robots, log)
    return rounded(found.drop("seq"), "gx", "gy", "fx", "fy")


@query
def first_contacts(spark, path):
    """The contacts by which parts of every run's fleet met for the first time."""
    pairs = cycle_pairs(spark, path).withColumn("t", F.col("cycle"))
    forest = fragmentation.first_contact_forest(pairs, ["run_id"])
    return forest.groupBy("run_id", "t").agg(F.count("*").alias("n_joined"))


@query
def contact_components(spark, path):
    by, here = ["run_id", "cycle"], cut_lineage(cycle_positions(spark, path))
    return fragmentation.contact_components(contact_links(here, 3.0, by), here.select(*by, "robot_id"), by)


@query
def union_connectivity(spark, path):
    pairs = cycle_pairs(spark, path).withColumn("t", F.col("cycle"))
    return fragmentation.union_connectivity(pairs, fx.fleet(spark, path), [5, 11, 17, 23])


@query
def cluster_similarity(spark, path):
    here = latest(spark, path)
    parts = fragmentation.contact_components(contact_links(here), here.select("run_id", "robot_id"))
    found = fragmentation.cluster_similarity(fx.fleet_agents(spark, path), parts)
    return rounded(found, "within_sim", "between_sim")


def round_inputs(spark, path):
    """Agents with their whole beliefs, a trade graph each, and noon as the moment of the round."""
    day = F.dayofmonth(F.to_date("run_id"))
    agents = fx.fleet_agents(spark, path).select("run_id", "robot_id", "z",
                                                 ((day * 10 + F.col("robot_id")) % 25).cast("long").alias("graph_id"))
    at = fx.fleet(spark, path).select("run_id").distinct().withColumn(
        "ts", F.to_timestamp("run_id") + F.expr("INTERVAL 12 HOURS"))
    return fx.world(spark, path), agents, *trade_graphs(spark, path), at


def wide_embedding(nodes, edges) -> DataFrame:
    """A user's embedding as long as the beliefs: 64 mixtures of the mean node features."""
    mean = knowledge.mean_features(nodes, edges)
    value = lambda k: (F.element_at("_mean", 1) * F.cos(k) + F.element_at("_mean", 2) * F.sin(k)
                       + F.element_at("_mean", 3) * F.cos(2 * k))
    return (mean.withColumnRenamed("z", "_mean")
            .withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(63)), value)).drop("_mean"))


@query
def sharing_round_sends(spark, path):
    sends = sharing_round.sharing_round(*round_inputs(spark, path), embed=wide_embedding).sends
    return rounded(sends, "min_sim", "node_retention")


@query
def sharing_round_beliefs(spark, path):
    beliefs = sharing_round.sharing_round(*round_inputs(spark, path), embed=wide_embedding).beliefs
    return rounded(beliefs.select("run_id", "robot_id", "n_folded", F.posexplode("z").alias("pos", "z")), "z")


def later_rounds(spark, path):
    """Three rounds a day; every fourth refresh fails."""
    telemetry, agents, nodes, edges, noon = round_inputs(spark, path)
    number = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("round")
    at = noon.select("run_id", "ts", number).withColumn("ts", F.col("ts") + F.make_dt_interval(hours=4 * F.col("round")))
    failed = agents.select("run_id", "robot_id", number).where((F.col("robot_id") + F.col("round")) % 4 == 0)
    return sharing_round.sharing_rounds(telemetry, agents, nodes, edges, at, embed=wide_embedding, failed=failed)


@query
def sharing_rounds_sends(spark, path):
    return rounded(later_rounds(spark, path).sends, "min_sim", "node_retention")


@query
def sharing_rounds_beliefs(spark, path):
    beliefs = later_rounds(spark, path).beliefs
    return rounded(beliefs.select("run_id", "robot_id", "n_folded", F.posexplode("z").alias("pos", "z")), "z")


@query
def graph_embeddings(spark, path):
    found = knowledge.embed_graphs(*trade_graphs(spark, path))
    return found.select("graph_id", *[r6(F.element_at("z", i + 1)).alias(f"z{i}") for i in range(3)])


@query
def packed_embeddings(spark, path):
    """Share graphs sent in parts of one row each and put together again: one vector a graph, whatever the parts."""
    packed = knowledge.pack_graphs(*messages.explode_graphs(good_shares(spark, path)), part_rows=1)
    found, _ = knowledge.embed_packed(packed, knowledge.mean_features)
    return found.select(F.col("graph_id").alias("msg_id"), *[r6(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(2)])


def order_graphs(spark, path) -> tuple[DataFrame, DataFrame]:
    """A graph per order, its lines being nodes; some lines are missing, and some edges end in lines that are not there."""
    fx.configure(spark)
    lines = fx.table(spark, path, "lineitem").select(F.col("l_orderkey").alias("graph_id"), (F.col("l_linenumber") - 1).cast("long").alias("node"),
                                                     "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("quantity"))
    nodes = lines.where("quantity <> 13").select("graph_id", F.col("node").alias("node_id"), F.array("quantity").alias("x"))
    relation = F.when(F.col("l_partkey") % 97 == 0, -1).otherwise(F.col("l_partkey") % 5).cast("int")
    return nodes, lines.select("graph_id", F.col("node").alias("src"), (F.col("l_suppkey") % 3).cast("long").alias("dst"), relation.alias("etype"))


@query
def compress_rejects(spark, path):
    """Graphs that a compress request must refuse, with everything that is wrong with them."""
    return knowledge.refused_graphs(*order_graphs(spark, path))


@query
def compress_accepted(spark, path):
    """Node counts of the graphs that pass the checks and are compressed."""
    stats = knowledge.compress_checked(*order_graphs(spark, path))[2]
    return stats.select("graph_id", "n_nodes", (F.col("n_kept") - F.col("bridge_nodes_kept")).alias("top_nodes"))


@query
def message_embeddings(spark, path):
    """A user's model on every share message: here the feature means, computed in Python."""
    def means(batch):
        graphs = [message["graph"]["x"] for message in batch]
        return [[sum(column) / len(rows) for column in zip(*rows)] for rows in graphs]

    found = knowledge.embed_messages(good_shares(spark, path), means, "payload")
    return found.select("msg_id", r6(F.element_at("z", 1)).alias("z0"), r6(F.element_at("z", 2)).alias("z1"))


@query
def monitor_cycles(spark, path):
    """Cycles from beliefs: each hour's active robots."""
    active = fx.telemetry(spark, path).select("run_id", "robot_id", F.hour("ts").alias("cycle")).distinct()
    beliefs = (active.join(fx.agents(spark, path).withColumnRenamed("agent_id", "robot_id"), "robot_id")
               .withColumn("elapsed_sec", F.col("cycle") * 3600))
    found = monitor.monitor_cycles(beliefs, cycle_merges(spark, path))
    return rounded(found.select("run_id", "cycle", "n_agents", "mean_sim", "merges", "baseline", "delta", "rise"),
                   "mean_sim", "baseline", "delta", "rise")


# Streams

def finished(stream, write, mode, out):
    batches.run_now(stream, write, mode, f"{out}/checkpoint")


@query
def stream_latest_positions(spark, path):
    out = batches.work_dir(spark)
    stream = stateless.stream_latest_positions(stateless.stream_telemetry(events_stream(spark, path)))
    finished(stream, batches.epoch_writer(f"{out}/table"), "update", out)
    found = batches.newest(spark, f"{out}/table", ["run_id", "robot_id"])
    return rounded(found.select("run_id", "robot_id", "event_id", "x", "y"), "x", "y")


def share_clock(events: DataFrame) -> DataFrame:
    """Poses (kind 0) and readable shares (kind 1) of a stream on one clock."""
    shares = messages.read_shares(fx.payloads(events))[0]
    poses = events.select("run_id", "robot_id", "ts", "event_id", "x", "y")
    return proximity.interleave(poses, shares.select("run_id", F.col("sender_id").alias("robot_id"), "ts",
                                                     F.col("msg_id").alias("event_id")))


def heard_table(spark, path) -> str:
    out = batches.work_dir(spark)
    expand = batches.receiver_batches(f"{out}/state", f"{out}/table", 3.0, HOUR)
    finished(share_clock(events_stream(spark, path)), expand, "append", out)
    return f"{out}/table"


@query
def stream_receivers(spark, path):
    return rounded(spark.read.parquet(heard_table(spark, path)).select("run_id", "msg_id", "sender_id", "receiver_id", "dist"), "dist")


@query
def stream_merge_counts(spark, path):
    heard, out = heard_table(spark, path), batches.work_dir(spark)
    schema = spark.read.parquet(heard).schema
    stream = stateless.stream_merge_counts(stateless.subscribe(spark, heard, schema))
    finished(stream, batches.epoch_writer(f"{out}/table"), "update", out)
    return batches.newest(spark, f"{out}/table", ["run_id", "sender_id", "receiver_id"])


def readings(spark, path) -> DataFrame:
    purchase = (F.col("event_type") == "purchase").cast("long")
    return events_stream(spark, path).select("run_id", "ts", "event_id", (F.col("value") / 490.02).alias("mean_sim"),
                                             purchase.alias("merges"))


def cycle_stream(spark, path) -> DataFrame:
    return stateless.stream_cycles(readings(spark, path), "1 hour")


@query
def stream_cycles(spark, path):
    out = batches.work_dir(spark)
    finished(cycle_stream(spark, path), batches.epoch_writer(f"{out}/table"), "append", out)
    return spark.read.parquet(f"{out}/table").select("run_id", us().alias("us"), r6("mean_sim").alias("mean_sim"), "merges")


@query
def stream_convergence(spark, path):
    """Cycles are judged as they close: the watermark hands them on in time order, which files of a table have not."""
    out = batches.work_dir(spark)
    finished(cycle_stream(spark, path), batches.convergence_batches(f"{out}/state", f"{out}/judged"), "append", out)
    found = spark.read.parquet(f"{out}/judged/table")
    return rounded(found.select("run_id", us().alias("us"), "mean_sim", "merges", "baseline", "delta", "rise", "stable",
                                "converged"), "mean_sim", "baseline", "delta", "rise")


def stuck_clock(events: DataFrame) -> DataFrame:
    """Every event is a pose and a sample; clicks and views also tick, sign-ups clear."""
    kinds = F.array(F.lit(motion.ODOM), F.lit(motion.SAMPLE))
    more = (F.when(F.col("event_type").isin("click", "view"), F.array(F.lit(motion.TICK)))
            .when(F.col("event_type") == "signup", F.array(F.lit(motion.CLEAR))).otherwise(F.array().cast("array<int>")))
    rows = events.select("run_id", "robot_id", "ts", F.explode(F.concat(kinds, more)).alias("kind"), "event_id", "x", "y",
                         F.col("cmd_speed").alias("speed"))
    late = F.when(F.col("kind") == motion.TICK, 2700 * 1000000).otherwise(0)
    return rows.withColumn("ts", F.timestamp_micros(us() + late))


@query
def stream_stuck(spark, path):
    out = batches.work_dir(spark)
    finished(stuck_clock(events_stream(spark, path)),
             batches.stuck_batches(f"{out}/state", f"{out}/table", 4 * HOUR, 6.0), "append", out)
    return spark.read.parquet(f"{out}/table").select("run_id", "robot_id", "event_id", "stuck")


@query
def stream_merge(spark, path):
    fx.configure(spark)
    out = batches.work_dir(spark)
    schema = fx.table(spark, path, "embeddings").schema
    raw = messages.read_telemetry(spark, fx.stream_path(path, "embeddings"), stream=True, schema=schema)
    events = raw.select(F.col("label").alias("receiver_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("r"))
    finished(events, batches.merge_batches(f"{out}/state", f"{out}/table", fx.agents(spark, path)), "append", out)
    found = batches.newest(spark, f"{out}/table", ["agent_id"])
    return rounded(found.select("agent_id", "n_folded", F.posexplode("z").alias("pos", "z")), "z")


@query
def stream_subscription(spark, path):
    """A late joiner: nothing from before the sixteenth is seen."""
    from datetime import datetime, timezone

    fx.configure(spark)
    out = batches.work_dir(spark)
    since = datetime(2024, 1, 16, tzinfo=timezone.utc)
    seen = stateless.subscribe(spark, fx.stream_path(path, "events"), RAW_EVENTS, since)
    finished(seen.select("event_id", "user_id"), batches.epoch_writer(f"{out}/table"), "append", out)
    return spark.read.parquet(f"{out}/table").select("event_id", "user_id")


@query
def stream_share_traffic(spark, path):
    out = batches.work_dir(spark)
    rows = fx.of_type(events_stream(spark, path), "purchase").select("run_id", "robot_id", "ts", F.col("event_type").alias("payload"))
    finished(stateless.stream_share_traffic(rows, "1 hour"), batches.epoch_writer(f"{out}/table"), "append", out)
    return spark.read.parquet(f"{out}/table").select("run_id", "robot_id", us("start").alias("start_us"), "broadcasts", "bytes")


@query
def stream_encounters(spark, path):
    """Encounters of sender and receiver of heard shares, closed after two hours apart.

    Files of one epoch are in no order of time, so they must come in one batch: a watermark would drop rows of later files.
    """
    heard, out = heard_table(spark, path), batches.work_dir(spark)
    contacts = stateless.subscribe(spark, heard, spark.read.parquet(heard).schema, files_per_trigger=None).select(
        "run_id", F.least("sender_id", "receiver_id").alias("i"), F.greatest("sender_id", "receiver_id").alias("j"), "ts")
    finished(stateless.stream_encounters(contacts, "2 hours"), batches.epoch_writer(f"{out}/table"), "append", out)
    return spark.read.parquet(f"{out}/table").select("run_id", "i", "j", us("start").alias("start_us"), us("end").alias("end_us"), "n_contacts")


@query
def stream_frontiers(spark, path):
    """Maps arriving as a stream, their frontier targets per batch."""
    fx.configure(spark)
    out = batches.work_dir(spark)
    fx.grids(spark, path).write.parquet(f"{out}/maps")
    arriving = spark.readStream.schema(fx.grids(spark, path).schema).parquet(f"{out}/maps")
    finished(arriving, batches.frontier_batches(f"{out}/table"), "append", out)
    return rounded(spark.read.parquet(f"{out}/table").select("map_id", "cluster_id", "n_cells", "tx", "ty"), "tx", "ty")
