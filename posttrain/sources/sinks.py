"""Sinks (S10, S11): per-step metric rows and sample preview tables.

Writes are Spark writes keyed by step, so a re-run of the same steps
overwrites the same partitions (idempotent on retry)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(status: DataFrame, step_col: str, metrics_col: str, split: str,
                logging_steps: int = 1) -> DataFrame:
    """A ``map<string,double>`` of metrics per step -> rows
    ``(step, split, metric, value)`` with the ``train/`` or ``eval/`` prefix,
    only every ``logging_steps`` steps."""
    prefix = "train/" if split == "train" else "eval/"
    d = status.filter(F.col(step_col) % logging_steps == 0)
    return d.select(F.col(step_col).alias("step"), F.lit(split).alias("split"),
                    F.explode(metrics_col).alias("metric", "value")).withColumn(
        "metric", F.concat(F.lit(prefix), F.col("metric")))


def write_metrics(rows: DataFrame, path: str) -> None:
    """Append-safe metric sink: partitioned by step, dynamic overwrite of the
    steps present (a retried step replaces its own rows)."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("split", "step").parquet(path))


def sample_preview(samples: DataFrame, step_col: str, order_col: str, text_col: str,
                   reward_col: str) -> DataFrame:
    """First sample of each step (by ``order_col``) as a preview row
    ``(step, text, reward)``; ``min_by`` keeps it one aggregate per step."""
    first = F.min_by(F.struct(F.col(text_col).alias("text"), F.col(reward_col).alias("reward")), F.col(order_col))
    return samples.groupBy(F.col(step_col).alias("step")).agg(first.alias("f")).select(
        "step", "f.text", "f.reward")
