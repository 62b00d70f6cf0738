"""Sources: pose telemetry and share messages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.sinks.rejects import with_rejects

TELEMETRY = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("robot_id", T.IntegerType()),
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("odom_x", "odom_y", "qx", "qy", "qz", "qw", "cmd_speed")]])

GRAPH_FIELDS = ("x array<array<float>>, edge_index array<array<bigint>>, edge_type array<bigint>, num_nodes int, "
                "agent_id int")
MESSAGE = f"sender_id int, graph struct<{GRAPH_FIELDS.replace(' array', ': array').replace(' int', ': int')}>, _bad string"


def read_telemetry(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = TELEMETRY,
                   **options) -> DataFrame:
    """All robots' poses as one table, or as one stream of files arriving in ``path``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(**options).parquet(path)


def read_shares(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse share messages: (messages with sender_id and graph, rejects with an error text).

    Malformed text and JSON that is not an object become rejects instead of failing the batch, and so do messages
    without a valid sender.
    """
    parsed = df.withColumn("_m", F.from_json("payload", MESSAGE, {"mode": "PERMISSIVE",
                                                                  "columnNameOfCorruptRecord": "_bad"}))
    is_object = F.ltrim("payload").startswith("{")
    sender = F.coalesce("_m.sender_id", F.lit(-1))
    readable = F.coalesce(is_object, F.lit(False)) & F.col("_m").isNotNull() & F.col("_m._bad").isNull()
    good, bad = with_rejects(parsed, {"malformed message": ~readable, "no sender": readable & (sender < 0)})
    return good.select(*df.columns, "_m.sender_id", "_m.graph"), bad.select(*df.columns, "error")


def explode_graphs(shares: DataFrame, key: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """Graph structs to (nodes, edges); optional ``node_offset`` is where a split message's nodes start."""
    offset = F.col("node_offset") if "node_offset" in shares.columns else F.lit(0)
    start = shares.select(F.col(key).alias("graph_id"), offset.cast("long").alias("_off"), "graph")
    nodes = start.select("graph_id", "_off", F.posexplode("graph.x").alias("_i", "x")).select(
        "graph_id", (F.col("_off") + F.col("_i")).alias("node_id"), "x")
    lines = F.arrays_zip(F.get("graph.edge_index", F.lit(0)).alias("src"), F.get("graph.edge_index", F.lit(1)).alias("dst"),
                         F.col("graph.edge_type").alias("etype"))
    edges = start.select("graph_id", "_off", F.posexplode(lines).alias("_i", "_e")).select(
        "graph_id", (F.col("_off") + F.col("_i")).alias("edge_pos"), "_e.src", "_e.dst", F.col("_e.etype").cast("int").alias("etype"))
    return nodes, edges
