"""What a long job leaves on disk while it runs."""
from pathlib import Path

from pyspark.sql import functions as F

from fleetweave.operators import scan
from fleetweave.operators.components import components
from fleetweave.session import cut_lineage, shared_dir, written


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {Path(f).name for f in files.split("\n") if "/shuffle_" in f}


def tables(spark):
    return {p for p in Path(shared_dir(spark).removeprefix("file:")).glob("table-*") if any(p.iterdir())}


def test_shuffle_files_go_with_the_step(spark):
    counts = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.collect_list("id").alias("ids"))
    for store in (written, cut_lineage):
        before = shuffled(spark)
        assert store(counts).count() == 1000
        left = {name for name in shuffled(spark) - before if name.endswith(".data")}
        assert len(left) <= 8  # the final count's own


def test_components_keep_their_result_only(spark):
    nodes = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("node"))
    edges = spark.range(299).select(F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    before = tables(spark)
    assert components(nodes, edges, ["g"]).select("component").distinct().count() == 1
    assert len(tables(spark) - before) == 1


def test_ranks_leave_one_table(spark):
    before = tables(spark)
    found = scan.ranked(spark.range(1000).withColumn("g", F.col("id") % 3), ["g"], ["id"], "rank")
    assert found.agg(F.max("rank")).first()[0] == 334 and len(tables(spark) - before) == 1
