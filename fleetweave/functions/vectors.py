"""Embedding vectors as array columns; arithmetic is in double."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetweave.functions.geometry import as_col
from fleetweave.params import NORM_FLOOR


def doubles(v) -> Column:
    return as_col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Inner product; both arrays must have the same length."""
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2(v) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(v, factor) -> Column:
    return F.transform(as_col(v), lambda x: x * factor)


def unit(v) -> Column:
    """Vector over its norm, the norm floored so that a zero vector stays zero."""
    norm = F.greatest(l2(v), F.lit(NORM_FLOOR))
    return F.transform(as_col(v), lambda x: x / norm)


def cosine(a, b) -> Column:
    norms = F.greatest(l2(a), F.lit(NORM_FLOOR)) * F.greatest(l2(b), F.lit(NORM_FLOOR))
    return dot(a, b) / norms


def blend(z, r, self_weight: float, recv_weight: float) -> Column:
    """One merge step: weighted sum of own and received vector, back to unit length."""
    mixed = F.zip_with(as_col(z), as_col(r), lambda x, y: x * self_weight + y * recv_weight)
    return unit(mixed)
