"""Streams over tables of many files, which come in no order of time."""
import os

import pytest

from __spark_entry__ import oracle_sql, queries
from compare import connect, differences

PATH = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")
MANY = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.minPartitionNum": "48",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}


@pytest.mark.parametrize("name", ["stream_convergence", "stream_encounters"])
def test_many_files(spark, name):
    before = {key: spark.conf.get(key, None) for key in MANY}
    try:
        for key, value in MANY.items():
            spark.conf.set(key, value)
        assert differences(spark, connect(PATH), PATH, name, queries()[name], oracle_sql()[name]) == []
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ties(path, source):
    """A copy of a table folder in which every event stands twice at its time, with other values and a larger id."""
    con = connect(source)
    for name in ("events", "embeddings"):
        more = "UNION ALL SELECT * REPLACE (event_id + 10000 AS event_id, 300 - value * 0.5 AS value) FROM events" if name == "events" else ""
        con.execute(f"COPY (SELECT * FROM {name} {more}) TO '{path}/{name}.parquet'")
    for name in ("region nation customer supplier part orders lineitem documents pages benchmark labels conversations").split():
        os.symlink(f"{source}/{name}.parquet", f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stream_convergence", "stream_encounters"])
def test_equal_times(spark, tmp_path, name):
    path = ties(tmp_path, "/root/testdata/sf0.001")
    assert differences(spark, connect(path), path, name, queries()[name], oracle_sql()[name]) == []
