"""posttrain: post-training data work (rollouts, rewards, advantages, batching,
objectives) expressed as Spark DataFrame plans.

Every public operator takes DataFrames and returns a DataFrame, or builds a
Column. Work runs inside Spark's joins, aggregates, windows and higher-order
array functions; grouped pandas is used only where an algorithm is sequential
by nature and its group is bounded (batch planning, stateful streaming).
"""

from posttrain.session import get_session, checkpoint_dir, table

__all__ = ["get_session", "checkpoint_dir", "table"]
