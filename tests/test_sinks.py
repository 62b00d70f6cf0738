import csv
from pathlib import Path

from pyspark.sql import functions as F

from fleetweave.functions import labels
from fleetweave.sinks import rejects, reports


def csv_inputs(spark, at):
    cycles = spark.createDataFrame([("north", 4, at(40), 40, 0.31, 0.25, 0.06, False), ("north", 5, at(50.25), 50, 0.44, 0.25, 0.19, True)],
                                   "run_id string, cycle int, ts timestamp, elapsed_sec int, mean_sim double, baseline double, "
                                   "rise double, converged boolean")
    spots = spark.createDataFrame([("north", 5, 3, 7.5, -1.25), ("north", 5, 8, 0.0, 3.0)],
                                  "run_id string, cycle int, robot_id int, x double, y double")
    counts = spark.createDataFrame([("north", 5, 8, 3, 12), ("north", 5, 3, 11, 4)],
                                   "run_id string, cycle int, sender_id int, receiver_id int, n_merges long")
    return cycles, spots, counts


def test_cycle_csv(spark, at, tmp_path):
    """The columns follow the fleet; the pair text lists every pair, also with a robot that has no column."""
    reports.write_cycle_csv(*csv_inputs(spark, at), [3, 5, 8], str(tmp_path / "out"))
    (file,) = Path(tmp_path / "out" / "run_id=north").glob("*.csv")
    first, second = csv.DictReader(file.open())
    assert list(second) == ["timestamp", "elapsed_sec", "mean_sim", "baseline", "rise", "converged", "robot3_x", "robot3_y",
                            "robot5_x", "robot5_y", "robot8_x", "robot8_y", "pair_counts"]
    assert second["pair_counts"] == "3-11:4;8-3:12" and second["robot5_x"] == second["robot5_y"] == ""
    assert (second["robot3_x"], second["robot3_y"], second["rise"], second["converged"]) == ("7.5", "-1.25", "0.19", "True")
    assert first["pair_counts"] == "" and first["converged"] == "False"
    assert (first["timestamp"], second["timestamp"]) == ("2024-01-01T00:00:40.000000", "2024-01-01T00:00:50.250000")


def test_empty_path_writes_nothing(spark, at, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    reports.write_cycle_csv(*csv_inputs(spark, at), [0], "")
    assert not list(tmp_path.iterdir())


def test_pairs_sort_by_number(spark):
    pairs = spark.createDataFrame([([(10, 2, 1), (2, 10, 3), (2, 9, 4)],), (None,)], "p array<struct<a:int,b:int,c:bigint>>")
    full, none = pairs.select(labels.format_pairs("p").alias("csv"), labels.format_active_pairs("p").alias("text")).collect()
    assert full.csv == "2-9:4;2-10:3;10-2:1" and full.text == "(2,9)×4  (2,10)×3  (10,2)×1" and none.text == "none"


def test_numbers_round_like_binary_doubles(spark):
    values = [0.125, 2.675, -0.5, 1234.5, -0.00001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(labels.fixed("v", 2).alias("a"), labels.fixed("v", 4, sign=True).alias("b")).collect()
    assert [r.a for r in got] == [f"{v:.2f}" for v in values] and [r.b for r in got] == [f"{v:+.4f}" for v in values]


def test_every_failure_keeps_its_reason(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    good, bad = rejects.with_rejects(df, {"too big": F.col("v") > 3, "odd": F.col("v") % 2 == 1})
    assert [r.v for r in good.collect()] == []
    assert {r.v: r.error for r in bad.collect()} == {1: "odd", 5: "too big; odd", None: "too big; odd"}


def test_markers(spark):
    positions = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 2, 1.0, 0.0), ("r", 5, None, None)],
                                      "run_id string, robot_id int, x double, y double")
    means = spark.createDataFrame([("r", 0, 1.0), ("r", 2, -1.0)], "run_id string, robot_id int, row_mean double")
    cycles = spark.createDataFrame([("r", 0, 0.1), ("r", 1, 0.25)], "run_id string, cycle int, mean_sim double")
    rows = {r.id: r for r in reports.marker_tables(positions, means, cycles).collect()}
    assert [(i, rows[i].ns) for i in sorted(rows)] == [(0, "robots"), (1, "labels"), (2, "robots"), (3, "labels"), (4, "comm_links"), (5, "hud")]
    assert (rows[0].r, rows[0].g) == (0.0, 1.0) and (rows[2].r, rows[2].g) == (1.0, 0.0)
    assert rows[1].text == "R0\n1.00" and rows[5].text == "Mean z* sim: 0.2500" and rows[4].x2 == 1.0
