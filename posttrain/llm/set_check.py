"""Exact check of candidate pairs on their full sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified(pairs: DataFrame, sets: DataFrame, percent: int, *extra: str) -> DataFrame:
    """``a, b`` and the ``extra`` columns of the pairs (``a, b``: keys of ``sets``: ``key, items``, distinct values) with
    100 * intersection >= percent * union."""
    both = (pairs.select("a", "b", *extra).join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select("a", "b", *extra)
