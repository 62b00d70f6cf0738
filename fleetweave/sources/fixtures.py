"""The general test tables read as this engine's inputs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.operators import scan
from fleetweave.operators.proximity import to_world
from fleetweave.session import configure


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def stream_path(path: str, name: str) -> str:
    """A table, be it one file or a folder of files, as the source of a stream: streams take a single file by a pattern only."""
    return f"{path}/{name}.parque[t]"


def shape_events(events: DataFrame) -> DataFrame:
    """Pose telemetry out of raw event rows; works on a batch or a stream."""
    ts = F.col("ts").cast("timestamp")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    half = k / F.lit(100.0) * F.lit(2 * 3.141592653589793) / 2
    return events.select(
        F.date_format(ts, "yyyy-MM-dd").alias("run_id"), (F.col("user_id") % 10).cast("int").alias("robot_id"),
        "event_id", ts.alias("ts"), "event_type", "value",
        (((F.col("value") * 100) % 2000) / 100 - 10).alias("odom_x"), (k % 20 - 10).cast("double").alias("odom_y"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(0.15).alias("cmd_speed"), k.alias("k"))


def telemetry(spark, path) -> DataFrame:
    configure(spark)
    return shape_events(table(spark, path, "events"))


def robots(spark, path) -> DataFrame:
    """Spawn offsets of robots 0 to 7; 8 and 9 are missing on purpose."""
    ids = table(spark, path, "events").select((F.col("user_id") % 10).cast("int").alias("robot_id")).distinct()
    return ids.where("robot_id < 8").select("robot_id", (F.col("robot_id") * 0.5).alias("spawn_x"),
                                            (F.col("robot_id") * -0.25).alias("spawn_y"))


def world(spark, path) -> DataFrame:
    return to_world(telemetry(spark, path), robots(spark, path))


def fleet(spark, path) -> DataFrame:
    """Every (run, robot) with telemetry."""
    return telemetry(spark, path).select("run_id", "robot_id").distinct()


def payloads(rows: DataFrame) -> DataFrame:
    """Share messages carried by purchase events; some are cut short to exercise rejects."""
    text = F.concat(F.lit('{"sender_id":'), F.col("robot_id").cast("string"),
                    F.lit(',"graph":{"x":[['), F.col("k").cast("string"), F.lit('.5,1.0],[0.25,'),
                    F.col("robot_id").cast("string"), F.lit('.0]],"edge_index":[[0,1],[1,0]],"edge_type":['),
                    F.col("k").cast("string"), F.lit(',3],"num_nodes":2,"agent_id":'),
                    F.col("robot_id").cast("string"), F.lit("}}"))
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(text, 1, 12)).otherwise(text)
    return (rows.where("event_type = 'purchase'")
            .select("run_id", F.col("event_id").alias("msg_id"), "ts", cut.alias("payload")))


def kg_share(spark, path) -> DataFrame:
    return payloads(telemetry(spark, path))


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    return rows.where(F.col("event_type").isin(*types))


def cycles(spark, path) -> DataFrame:
    """One reading per run and hour: running mean of scaled values, running count of purchases."""
    hourly = (telemetry(spark, path).groupBy("run_id", F.hour("ts").alias("cycle"))
              .agg(F.sum(F.col("value") / 490.02).alias("_s"), F.count("*").alias("_n"),
                   F.sum((F.col("event_type") == "purchase").cast("long")).alias("_m")))
    sums = scan.running(hourly, ["run_id"], ["cycle"], scan.by_number("cycle"),
                        total={"s": "_s", "n": "_n", "merges": "_m"})
    return sums.select("run_id", "cycle", (F.col("cycle") * 3600).cast("long").alias("elapsed_sec"),
                       F.round(F.col("s") / F.col("n"), 9).alias("mean_sim"), "merges",
                       F.col("_m").alias("new_merges"))


def runs(spark, path) -> DataFrame:
    day = F.dayofmonth(F.to_date("run_id"))
    sizes = F.array(F.lit(3), F.lit(5), F.lit(8))
    return (telemetry(spark, path).select("run_id").distinct()
            .select("run_id", F.element_at(sizes, (day % 3 + 1).cast("int")).alias("n_robots"),
                    F.floor(day / 3).cast("int").alias("seed")))


def vectors(spark, path) -> DataFrame:
    """All embeddings, ten to a run."""
    configure(spark)
    return table(spark, path, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("run_id"), (F.col("vec_id") % 10).cast("int").alias("robot_id"),
        F.col("vec_id").alias("agent_id"), "label", F.col("embedding").cast("array<double>").alias("z"))


def agents(spark, path) -> DataFrame:
    """One agent per label, believing the label's first vector."""
    first = F.min_by("z", "agent_id").alias("z")
    return vectors(spark, path).groupBy(F.col("label").alias("agent_id")).agg(first)


def merge_events(spark, path) -> DataFrame:
    return vectors(spark, path).select(F.col("label").alias("receiver_id"), F.col("agent_id").alias("seq"),
                                       F.col("z").alias("r"))


def fleet_agents(spark, path) -> DataFrame:
    """The agents' beliefs for every (run, robot): robot id = label."""
    beliefs = agents(spark, path).select(F.col("agent_id").alias("robot_id"), "z")
    return fleet(spark, path).join(beliefs, "robot_id").select("run_id", "robot_id", "z")


def grids(spark, path) -> DataFrame:
    """Occupancy grids of 20 by 10 cells, one per 200 parts; the last may be partial and is padded as unknown."""
    configure(spark)
    code = F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size") * 2).cast("int")
    cells = table(spark, path, "part").select(F.floor(F.col("p_partkey") / 200).cast("long").alias("map_id"),
                                              (F.col("p_partkey") % 200).cast("int").alias("pos"), code.alias("v"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(199)),
                         lambda i: F.coalesce(F.try_element_at(F.col("by_pos"), i), F.lit(-1)).cast("tinyint"))
    return (cells.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("by_pos"))
            .select("map_id", F.lit(0).cast("long").alias("seq"), F.lit(20).alias("width"), F.lit(10).alias("height"),
                    F.lit(0.05).alias("resolution"), (-F.col("map_id")).cast("double").alias("origin_x"),
                    F.col("map_id").cast("double").alias("origin_y"), filled.alias("data")))


def goal_log(spark, path) -> DataFrame:
    configure(spark)
    gx, gy = (F.col("o_orderkey") % 7) * 0.15, (F.col("o_orderkey") % 5) * 0.15
    start = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1000000)
    took = F.floor("o_totalprice") % 150
    return table(spark, path, "orders").select(
        (F.col("o_custkey") % 10).cast("int").alias("robot_id"), F.col("o_orderkey").alias("goal_num"),
        start.alias("ts"), gx.alias("gx"), gy.alias("gy"), gx.alias("fx"), gy.alias("fy"),
        (gx - 1).alias("sx"), gy.alias("sy"), (gx - 1 + (F.col("o_custkey") % 3) * 0.06).alias("ex"), gy.alias("ey"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("result"),
        F.timestamp_micros(F.unix_micros(start) + took * 1000000).alias("end_ts"))


def edges(spark, path) -> DataFrame:
    """Trade graph of each nation; a node id is its kind times 10^9 plus its key."""
    configure(spark)
    big = 1_000_000_000
    customers = table(spark, path, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("graph_id"))
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey").join(
        customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Both relations of a line come from one join, and their repeats go in one exchange.
    line = F.explode(F.array(
        F.struct((F.col("l_orderkey") + 2 * big).alias("src"), (F.col("l_partkey") + 3 * big).alias("dst"), F.lit(4).alias("etype")),
        F.struct((F.col("l_partkey") + 3 * big).alias("src"), (F.col("l_suppkey") + 4 * big).alias("dst"), F.lit(5).alias("etype"))))
    found = (
        customers.select("graph_id", (F.col("c_custkey") + big).alias("src"), F.col("graph_id").alias("dst"), F.lit(1).alias("etype")),
        orders.select("graph_id", (F.col("o_orderkey") + 2 * big).alias("src"), (F.col("c_custkey") + big).alias("dst"), F.lit(3).alias("etype")),
        lines.select("graph_id", line.alias("_line")).select("graph_id", "_line.*").distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nodes(spark, path) -> DataFrame:
    return nodes_of(edges(spark, path), spark, path)


def nodes_of(trade: DataFrame, spark, path) -> DataFrame:
    """Endpoints of the trade graphs plus suppliers of the nation itself; features derive from the id.

    The customer of an order, the order of a line and its part are ends of relation 1, 3 or 5 too, so no other end is read.
    """
    ends = trade.where("etype <> 4").select("graph_id", F.explode(
        F.when(F.col("etype") == 3, F.array("src")).otherwise(F.array("src", "dst"))).alias("node_id"))
    own = table(spark, path, "supplier").select(F.col("s_nationkey").cast("long").alias("graph_id"),
                                                (F.col("s_suppkey") + 4_000_000_000).alias("node_id"))
    feature = F.array((F.col("node_id") % 7).cast("double"), (F.col("node_id") % 11).cast("double"),
                      F.floor(F.col("node_id") / 1_000_000_000).cast("double"))
    return ends.unionByName(own).distinct().withColumn("x", feature)
