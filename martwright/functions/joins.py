"""Joins of events to a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join on `key` in which AQE can split a hot key of `events`.

    AQE splits an oversized join partition only when both inputs come straight from a
    shuffle made for that join. A table that was grouped or joined by the key before is
    partitioned by it already and gets none, which leaves all events of a hot key to one
    task. Null-safe equality hashes the key in another way than grouping does, so here
    both inputs are shuffled. NULL keys are dropped before it, as in any equi join.
    """
    other = f"__{key}"
    left = events.where(F.col(key).isNotNull())
    right = table.where(F.col(key).isNotNull()).withColumnRenamed(key, other)
    return left.join(right, left[key].eqNullSafe(right[other])).drop(other)
