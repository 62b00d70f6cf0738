"""Planar geometry as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetweave.params import GOAL_PROJECT, ON_TARGET, UNKNOWN_DISTANCE, WALL_MARGIN


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def yaw(qx, qy, qz, qw) -> Column:
    """Heading of a unit quaternion around the vertical axis."""
    x, y, z, w = map(as_col, (qx, qy, qz, qw))
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = as_col(ax) - as_col(bx), as_col(ay) - as_col(by)
    return F.sqrt(dx * dx + dy * dy)


def distance_or_unknown(ax, ay, bx, by, unknown: float = UNKNOWN_DISTANCE) -> Column:
    """Distance, or the sentinel when either position is missing."""
    return F.coalesce(distance(ax, ay, bx, by), F.lit(unknown))


def angle_diff(target, current) -> Column:
    """Signed heading error wrapped into (-pi, pi]. Spark reads -0.0 as 0.0, so a target on the spot has heading 0."""
    d = as_col(target) - as_col(current)
    return F.atan2(F.sin(d), F.cos(d))


def near_wall(x, y, world_size: float = 20.0) -> Column:
    half = world_size / 2.0 - WALL_MARGIN
    return (F.abs(as_col(x)) > half) | (F.abs(as_col(y)) > half)


def cell_to_world(origin, cell, resolution) -> Column:
    """World coordinate of a (mean) cell index: the cell's centre, not its corner."""
    return as_col(origin) + (as_col(cell) + 0.5) * as_col(resolution)


def project_out(rx, ry, fx, fy, dist: float = GOAL_PROJECT) -> Column:
    """Point ``dist`` from the robot towards the target; NULL when they coincide and give no heading."""
    rx, ry, fx, fy = map(as_col, (rx, ry, fx, fy))
    d = distance(fx, fy, rx, ry)
    point = F.struct((rx + (fx - rx) / d * dist).alias("x"), (ry + (fy - ry) / d * dist).alias("y"))
    return F.when(d >= ON_TARGET, point)
