"""Input sizes from the optimizer's statistics, and size-checked broadcasts.

No job runs for an estimate. A frame's input size is the sum over the leaves of
its plan (scans and local rows): the estimate of a join multiplies its sides and
says nothing about bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: From here on a leaf's size is Spark's word for unknown (rows of the driver, a
#: streaming micro-batch).
UNKNOWN_BYTES = 1 << 62


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the leaves that the plan reads; leaves of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN_BYTES)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``F.broadcast(df)`` when its estimated size is under ``limit``; the frame
    unchanged otherwise (the planner then joins by a shuffle)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
