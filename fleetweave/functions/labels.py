"""Categories, colours and report text as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetweave.functions.geometry import as_col
from fleetweave.params import (OCCUPIED_FROM, RETENTION_BANDS, RETENTION_ELSE, TREND_STEP, UNKNOWN_CELL)

# Fixed wording of the reports.
TREND_UP, TREND_DOWN, TREND_FLAT = "↑ converging", "↓ diverging", "→ stable"
STATUS_DONE, STATUS_OPEN = "CONVERGED ✓ (monitoring continues)", "NOT YET"


def fixed(value, digits: int, sign: bool = False) -> Column:
    """Decimal text, rounding the exact binary value half-even (``format_string`` would round half-up)."""
    zeros = "0." + "0" * digits
    pattern = f"+{zeros};-{zeros}" if sign else zeros
    return F.call_function("format_number", as_col(value), F.lit(pattern))


def retention_band(sim) -> Column:
    """Share of a graph to keep: less for peers that already agree."""
    sim = as_col(sim)
    (high, low_share), (mid, mid_share) = RETENTION_BANDS
    return F.when(sim > high, low_share).when(sim > mid, mid_share).otherwise(RETENTION_ELSE)


def trend(delta) -> Column:
    delta = as_col(delta)
    return F.when(delta > TREND_STEP, TREND_UP).when(delta < -TREND_STEP, TREND_DOWN).otherwise(TREND_FLAT)


def sim_colour(mean) -> Column:
    """Red for low, green for high mean similarity."""
    green = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (as_col(mean) + 1.0) / 2.0))
    return F.struct((1.0 - green).alias("r"), green.alias("g"), F.lit(0.0).alias("b"))


def cell_class(v) -> Column:
    v = as_col(v)
    return F.when(v == UNKNOWN_CELL, "unknown").when((v >= 0) & (v < OCCUPIED_FROM), "free").otherwise("occupied")


def elapsed_sec(ts, start) -> Column:
    """Whole seconds between two timestamps."""
    return F.floor((F.unix_micros(as_col(ts)) - F.unix_micros(as_col(start))) / 1000000).cast("long")


def robot_label(robot_id, mean) -> Column:
    return F.concat(F.lit("R"), as_col(robot_id).cast("string"), F.lit("\n"), fixed(mean, 2))


def banner_label(mean) -> Column:
    return F.concat(F.lit("Mean z* sim: "), fixed(mean, 4))


def _join_pairs(pairs, line, separator: str) -> Column:
    """Text of ``array<struct<a,b,c>>`` in numeric (a, b) order."""
    return F.array_join(F.transform(F.array_sort(as_col(pairs)), line), separator)


def format_pairs(pairs) -> Column:
    return _join_pairs(pairs, lambda p: F.concat_ws("", p["a"].cast("string"), F.lit("-"), p["b"].cast("string"),
                                                    F.lit(":"), p["c"].cast("string")), ";")


def format_active_pairs(pairs) -> Column:
    text = _join_pairs(pairs, lambda p: F.concat_ws("", F.lit("("), p["a"].cast("string"), F.lit(","),
                                                    p["b"].cast("string"), F.lit(")×"), p["c"].cast("string")), "  ")
    return F.when(F.coalesce(text, F.lit("")) == "", "none").otherwise(text)
