"""Operator parameters and the fixed values results depend on."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Tunable parameters with their standard defaults."""

    comm_range: float = 3.0
    min_rise: float = 0.03
    stability_eps: float = 0.005
    stable_cycles: int = 3
    stuck_window: float = 4.0
    stuck_epsilon: float = 0.05
    escape_reverse: float = 0.9
    escape_suppress: float = 4.0
    repeat_radius: float = 1.0
    repeat_window: float = 60.0
    disperse_sec: float = 10.0
    world_size: float = 20.0
    walk_speed: float = 0.15
    self_weight: float = 0.7
    recv_weight: float = 0.3
    retention: float = 0.40


# Results must agree on these.
UNKNOWN_DISTANCE = 999.0
NO_RETENTION = -1.0
NO_AGENT = -1
NORM_FLOOR = 1e-8
MERGE_GATE = 0.5
TREND_STEP = 0.005
WALL_MARGIN = 0.5
RETENTION_BANDS = ((0.7, 0.20), (0.4, 0.40))
RETENTION_ELSE = 0.65
UNKNOWN_CELL = -1
OCCUPIED_FROM = 50
MIN_CLUSTER = 4
BLACKLIST_RADIUS = 0.4
MIN_GOAL_DIST = 0.5
GOAL_PROJECT = 0.7
RESEND_RADIUS = 0.2
MIN_MOVE = 0.1
GOAL_TIMEOUT = 120.0
MIN_GOAL_PERIOD = 2.0
MAP_REFRESH = 5.0
ON_TARGET = 1e-2
