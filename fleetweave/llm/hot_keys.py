"""Joins of many rows with one row per key, where a few keys may hold most of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.scratch import shuffle_width


def looked_up(rows: DataFrame, answers: DataFrame, key: str, count: Column, total: int) -> DataFrame:
    """Every row of ``rows`` that has an answer, with it. ``answers`` has one row per ``key`` and no other common column.

    ``count`` is the number of rows of a key and ``total`` that of all. Keys that hold more than their share of a
    partition are fewer than there are partitions, so their answers are sent to every task and their rows stay where they
    are; the rest meets in a shuffle. ``rows`` is read twice.
    """
    heavy = count * shuffle_width(rows) > total
    few = F.broadcast(answers.where(heavy))
    rest = rows.join(F.broadcast(answers.where(heavy).select(key)), key, "left_anti").join(answers.where(~heavy), key)
    return rows.join(few, key).unionByName(rest)
