"""Helpers for column expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIDE = 32  # splitters compared at a time


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside another function's lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def range_of(key: Column, marks: list[int]) -> Column:
    """Number of splitters up to the key: first among every ``STRIDE``-th of every ``STRIDE``-th one, then between those."""
    if not marks:
        return F.lit(0)
    listed = lambda some: F.lit(some).cast("array<bigint>")
    passed = lambda some: F.size(F.filter(some, lambda m: m <= key))
    levels = [marks]
    while len(levels[-1]) >= STRIDE:
        levels.append(levels[-1][STRIDE - 1::STRIDE])
    def within(low: Column, some: Column) -> Column:
        return let(low * STRIDE, lambda first: first + passed(F.slice(some, first + 1, STRIDE)))

    found = passed(listed(levels.pop()))
    while levels:
        found = within(found, listed(levels.pop()))
    return found
