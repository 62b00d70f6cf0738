"""Plans keep their shape: equi-joins only, pruned scans, no whole key in one window."""
import os
import re

import pytest

from __spark_entry__ import queries

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")


def plan(spark, name):
    return queries()[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pairs_in_range", "share_fanout", "similarity_matrix", "run_summary", "usable_targets",
                                  "goal_outcomes", "stuck_ticks", "behaviour_timeline", "compression_stats", "markers"])
def test_only_equi_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_windows_run_inside_chunks(spark):
    specs = re.findall(r"windowspecdefinition\(run_id#\d+, robot_id#\d+, (_chunk)", plan(spark, "share_positions"))
    assert specs


def test_scans_read_only_what_they_need(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "wall_proximity"))
    assert schemas and all("event_type" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in plan(spark, "share_messages")
