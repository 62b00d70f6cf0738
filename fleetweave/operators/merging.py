"""Share traffic, merge counts and the merge itself."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions.vectors import blend, doubles, l2
from fleetweave.operators import scan
from fleetweave.operators.folds import ROUND_ROWS, fold_states
from fleetweave.params import MERGE_GATE


def merge_counts(receivers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Directed count per (sender, receiver) of shares heard in range."""
    by = ["run_id"] if by is None else by
    return receivers.groupBy(*by, "sender_id", "receiver_id").agg(F.count("*").alias("n_merges"))


def merge_report(counts: DataFrame) -> DataFrame:
    """Per-pair counts and, with is_total, the total of each run."""
    pair = F.struct("sender_id", "receiver_id")
    rolled = (counts.withColumn("_pair", pair).groupBy("run_id", "_pair").agg(F.sum("n_merges").alias("_n"))
              .rollup("run_id", "_pair").agg(F.sum("_n").alias("n_merges"), F.grouping("_pair").alias("_all"),
                                             F.grouping("run_id").alias("_runs")))
    return rolled.where("_runs = 0").select("run_id", "_pair.sender_id", "_pair.receiver_id", "n_merges",
                                            (F.col("_all") == 1).alias("is_total"))


def running_merges(cycles: DataFrame, merges: DataFrame) -> DataFrame:
    """Cumulative merges of each run at each cycle; ``merges(run_id, cycle, n)``.

    Merges of a cycle that has no row of its own, because its reading failed, count from the next one on.
    """
    marked = cycles.select("run_id", "cycle", F.lit(0).cast("long").alias("n"), F.lit(True).alias("_listed"))
    both = marked.unionByName(merges.select("run_id", "cycle", F.col("n").cast("long"), F.lit(False).alias("_listed")))
    summed = both.groupBy("run_id", "cycle").agg(F.sum("n").alias("_n"), F.max("_listed").alias("_listed"))
    totals = scan.running(summed, ["run_id"], ["cycle"], scan.by_number("cycle"), total={"merges": "_n"})
    return totals.where("_listed").select("run_id", "cycle", "merges")


def running_pairs(cycles: DataFrame, merges: DataFrame) -> DataFrame:
    """Per cycle of each run, every pair that has merged so far with its count: (run_id, cycle, sender_id, receiver_id,
    n_merges). ``merges(run_id, cycle, sender_id, receiver_id, n)``; the result has a row per pair and later cycle.
    """
    pair = ["run_id", "sender_id", "receiver_id"]
    firsts = merges.groupBy(*pair).agg(F.min("cycle").alias("_first"))
    due = cycles.select("run_id", "cycle").join(firsts, "run_id").where("cycle >= _first")
    due = due.select(*pair, "cycle", F.lit(0).cast("long").alias("n"), F.lit(True).alias("_listed"))
    both = due.unionByName(merges.select(*pair, "cycle", F.col("n").cast("long"), F.lit(False).alias("_listed")))
    summed = both.groupBy(*pair, "cycle").agg(F.sum("n").alias("_n"), F.max("_listed").alias("_listed"))
    totals = scan.running(summed, pair, ["cycle"], scan.by_number("cycle"), total={"n_merges": "_n"})
    return totals.where("_listed").select("run_id", "cycle", "sender_id", "receiver_id", "n_merges")


def checked_merges(agents: DataFrame, events: DataFrame, keys: tuple[str, str] = ("agent_id", "receiver_id")) -> DataFrame:
    """``events`` with ``error``: null, or why a merge request cannot be carried out; the agent's belief stays as it was."""
    agent, receiver = keys
    common = [c for c in agents.columns if c in events.columns and c not in (agent, "z")]
    sizes = agents.select(*common, F.col(agent).alias(receiver), F.size("z").alias("_size"))
    odd = F.exists("r", lambda x: x.isNull() | F.isnan(x.cast("double")))
    error = (F.when(F.col("_size").isNull(), F.concat(F.lit("unknown agent "), F.coalesce(F.col(receiver).cast("string"), F.lit("null"))))
             .when(F.col("r").isNull(), F.lit("no vector"))
             .when(F.size("r") != F.col("_size"), F.format_string("expected %d values, got %d", "_size", F.size("r")))
             .when(odd, F.lit("not a number")))
    return events.join(sizes, [*common, receiver], "left").withColumn("error", error).drop("_size")


def share_traffic(shares: DataFrame, receivers: DataFrame, interval: str = "8 seconds") -> DataFrame:
    """Broadcasts, recipients, bytes and, when shares carry ``retention``, its mean, per robot and interval.

    ``shares(run_id, msg_id, ts, sender_id, payload[, retention])``; ``receivers`` as from ``share_receivers``.
    """
    heard = receivers.groupBy("run_id", "msg_id").agg(F.count("*").alias("_heard"))
    sent = shares if "retention" in shares.columns else shares.withColumn("retention", F.lit(None).cast("double"))
    return (sent.join(heard, ["run_id", "msg_id"], "left")
            .groupBy("run_id", F.col("sender_id").alias("robot_id"), F.window("ts", interval)["start"].alias("bucket"))
            .agg(F.count("*").alias("broadcasts"), F.sum(F.coalesce("_heard", F.lit(0))).cast("long").alias("recipients"),
                 F.avg("retention").alias("mean_retention"), F.sum(F.octet_length("payload")).cast("long").alias("bytes")))


def merge_embeddings(agents: DataFrame, events: DataFrame, self_w: float = 0.7, recv_w: float = 0.3,
                     keys: tuple[str, str] = ("agent_id", "receiver_id"), rows: int = ROUND_ROWS) -> DataFrame:
    """Fold each receiver's incoming vectors, in ``seq`` order, into its belief.

    ``agents(agent_id, z)``, ``events(receiver_id, seq, r)``; an agent without events keeps its belief, and events that
    ``checked_merges`` finds fault with are passed over. The step renormalises, so it is not associative and one receiver's history is inherently sequential.
    """
    agent, receiver = keys
    common = [c for c in agents.columns if c in events.columns and c not in (agent, "z")]
    events = checked_merges(agents, events, keys).where("error is null")
    incoming = events.select(*common, F.col(receiver).alias(agent), "seq", doubles("r").alias("r"))
    start = agents.withColumn("z", doubles("z"))
    return fold_states(start, incoming, [*common, agent], "seq", "r", "z",
                       lambda z, r: blend(z, r, self_w, recv_w), rows=rows)


def merge_reply(folded: DataFrame) -> DataFrame:
    """Reply columns of a merge: the new belief, the constant gate and the norm."""
    return folded.withColumnRenamed("z", "z_star").withColumns({"gate": F.lit(MERGE_GATE), "z_norm": l2("z_star")})
