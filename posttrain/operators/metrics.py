"""Evaluation and reward statistics.

All of these are grouped aggregates; Spark combines partial aggregates map-side,
so a hot datasource or task only costs one partial row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: default k list of the code-eval metric
DEFAULT_K = (1, 10, 100)


def task_tally(outcomes: DataFrame, task_col: str = "task_id",
               passed_col: str = "passed") -> DataFrame:
    """A2: per task, number of completions and number passed."""
    return outcomes.groupBy(task_col).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.col(passed_col).cast("long")).alias("n_passed"))


def pass_at_k_estimator(n, c, k):
    """Unbiased pass@k of one task: 1 - C(n-c, k) / C(n, k), as the product over
    j < k of (n-c-j) / (n-j) (k steps, however many passed); 1.0 when n-c < k, 0.0
    when nothing passed."""
    prod = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(k, n) - 1, F.lit(0)).cast("int")), F.lit(1.0),
                       lambda acc, j: acc * (n - c - j) / F.greatest(n - j, F.lit(1)))
    return F.when(n - c < k, F.lit(1.0)).when(c <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k(outcomes: DataFrame, ks: Sequence[int] = DEFAULT_K,
              task_col: str = "task_id", passed_col: str = "passed") -> DataFrame:
    """A1: mean pass@k over tasks for each k; a k is reported only if every
    task has at least k completions. Output ``(k, pass_at_k)``."""
    tally = task_tally(outcomes, task_col, passed_col)
    per_task = tally.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).select(
        "k", F.col("n_total").alias("n"),
        pass_at_k_estimator(F.col("n_total"), F.col("n_passed"), F.col("k")).alias("p"))
    return (per_task.groupBy("k")
            .agg(F.avg("p").alias("pass_at_k"), F.min("n").alias("min_n"))
            .filter(F.col("min_n") >= F.col("k")).drop("min_n"))


def eval_by_datasource(rollouts: DataFrame, n_samples: int, group_col: str = "group_id",
                       idx_col: str = "sample_idx", ds_col: str = "datasource",
                       reward_col: str = "reward") -> DataFrame:
    """A3: per datasource, passN = mean over prompts of max reward, pass1 = mean
    over prompts of mean reward; the datasource of a prompt is its first sample's.
    With n_samples == 1 passN is not computed (it collides with pass1)."""
    per_prompt = rollouts.groupBy(group_col).agg(
        F.min_by(F.col(ds_col), F.col(idx_col)).alias(ds_col),
        F.max(reward_col).alias("__max"), F.avg(reward_col).alias("__mean"))
    aggs = [F.count(F.lit(1)).alias("n_prompts"), F.avg("__mean").alias("pass1")]
    if n_samples > 1:
        aggs.insert(1, F.avg("__max").alias(f"pass{n_samples}"))
    return per_prompt.groupBy(ds_col).agg(*aggs)


def reward_stats_by_datasource(samples: DataFrame, ds_col: str = "datasource",
                               reward_col: str = "reward") -> DataFrame:
    """Mean reward, count and passed (reward > 0) per datasource."""
    return samples.groupBy(ds_col).agg(
        F.avg(reward_col).alias("mean_reward"),
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.col(reward_col) > 0, 1).otherwise(0)).cast("long").alias("passed"))


def filter_pass_rate(seen: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept / seen * 100 over the accumulation span (two counts, one row)."""
    a = seen.agg(F.count(F.lit(1)).alias("n_seen")).withColumn(
        "n_kept", kept.agg(F.count(F.lit(1))).scalar())
    return a.select(
        "n_seen", "n_kept",
        (F.col("n_kept") / F.nullif(F.col("n_seen"), F.lit(0)) * 100.0).alias("pass_rate"))


def return_sum(tokens: DataFrame, sample_col: str = "sample_id",
               reward_col: str = "token_reward") -> DataFrame:
    """Per-sample sum of token rewards (unmasked), logged as ``return``."""
    return tokens.groupBy(sample_col).agg(F.sum(reward_col).alias("return"))


def dataset_profile(df: DataFrame, n: int = 3, seed: int = 0,
                    id_col: str | None = None) -> DataFrame:
    """Row count plus ``n`` rows chosen by the md5 of ``seed:id`` (of all columns
    without ``id_col``), ties by all columns: the same rows in every run."""
    named = [F.col(id_col)] if id_col else [F.col(c) for c in df.columns]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in named)))
    picked = df.withColumn("__h", key).orderBy("__h", *df.columns).limit(n).drop("__h")
    return picked.withColumn("n_rows", df.agg(F.count(F.lit(1))).scalar())


def seqlen_unbalance(lengths: DataFrame, parts: int, seq_col: str = "_seq",
                     len_col: str = "length", part_col: str | None = None) -> DataFrame:
    """Per grouping ('contiguous' chunks of floor(n/k) rows - a ragged
    tail is its own chunk - or the given balanced partition column) the
    min/max/diff of partition sums and the mean total/k. One row per kind."""
    if "__n" in lengths.columns:  # row count attached by the position step
        d = lengths
    else:
        d = lengths.withColumn("__n", lengths.agg(F.count(F.lit(1))).scalar())
    d = d.withColumn(
        "__chunk", F.floor(F.col(seq_col) / F.greatest(F.floor(F.col("__n") / F.lit(parts)), F.lit(1))).cast("long"))
    kinds = [("contiguous", "__chunk")]
    if part_col:
        kinds.append(("balanced", part_col))
    out = None
    for name, c in kinds:
        s = d.groupBy(c).agg(F.sum(len_col).alias("__s")).agg(
            F.min("__s").alias("min_sum"), F.max("__s").alias("max_sum"))
        tot = d.agg(F.sum(len_col) / F.lit(float(parts))).scalar()
        r = s.select(F.lit(name).alias("kind"), "min_sum", "max_sum",
                     (F.col("max_sum") - F.col("min_sum")).alias("diff"), tot.alias("mean_sum"))
        out = r if out is None else out.unionByName(r)
    return out
