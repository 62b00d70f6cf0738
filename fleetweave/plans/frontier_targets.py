"""From occupancy grids to each robot's next goal, all maps at once."""
from __future__ import annotations

from pyspark.sql import DataFrame

from fleetweave.operators import frontiers, goals
from fleetweave.params import MIN_CLUSTER


def frontier_targets(grids: DataFrame, robots: DataFrame, blacklist: DataFrame | None = None,
                     min_cells: int = MIN_CLUSTER) -> DataFrame:
    """``robots(map_id, seq, robot_id, x, y)``, ``blacklist(map_id, seq, bx, by)``; see ``next_targets``."""
    labelled = frontiers.frontier_clusters(frontiers.grid_frontier(grids))
    targets = frontiers.cluster_centroids(labelled, grids, min_cells)
    return goals.next_targets(robots, targets, blacklist)


def explored_targets(grids: DataFrame, robots: DataFrame, goal_log: DataFrame, min_cells: int = MIN_CLUSTER) -> DataFrame:
    """Targets of every robot given what it has tried: the log's outcomes ban points for later choices of that robot.

    ``robots(map_id, seq, robot_id, ts, x, y)`` has the time of each choice; several robots may share a map.
    """
    labelled = frontiers.frontier_clusters(frontiers.grid_frontier(grids))
    targets = frontiers.cluster_centroids(labelled, grids, min_cells)
    return goals.next_targets(robots, targets, goals.timed_blacklist(goals.goal_outcomes(goal_log)))
