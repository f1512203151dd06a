"""Logged agent trajectories (F5, F6): token streams, action spans, rewards
and rollout log-prob alignment, rebuilt from per-turn rows.

Turn rows carry ``(conv_id, turn, role, ids, reward, score, lps)``; windows are
per conversation (bounded by its number of turns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectory_assembly(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", ids_col: str = "ids", reward_col: str = "step_reward",
                        score_col: str = "step_score", lp_col: str = "action_lps") -> DataFrame:
    """the observation is every turn in order (prompt, then per step the
    action and its environment feedback). Per conversation: the observation's
    tokens, total length, action spans [start, end), summed step rewards, the last step's score,
    and the rollout log-probs: each step's action values are appended to the
    list, then zeros pad it to the observation length so far (so the first
    step's values sit at position 0, as the logged loop produces them)."""
    wo = Window.partitionBy(conv_col).orderBy(turn_col)
    d = turns.withColumn("__n", F.size(ids_col))
    d = d.withColumn("__start", F.coalesce(F.sum("__n").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    is_act = F.col(role_col) == "assistant"
    d = d.withColumn("__step", F.sum(is_act.cast("int")).over(wo.rowsBetween(Window.unboundedPreceding, 0)))
    # obs length before each step's action: the step's action start, except the
    # first step whose values are written from position 0
    first_step = F.min(F.when(is_act, F.col(turn_col))).over(Window.partitionBy(conv_col))
    d = d.withColumn("__lp_pos", F.when(is_act & (F.col(turn_col) == first_step), F.lit(0)).otherwise(F.col("__start")))
    per = d.groupBy(conv_col).agg(
        F.sum("__n").alias("total_len"),
        F.array_sort(F.collect_list(F.when(is_act, F.struct(F.col("__start").alias("start"),
                                                           (F.col("__start") + F.col("__n")).alias("end"))))).alias("action_ranges"),
        F.sum(F.when(is_act, F.col(reward_col)).otherwise(0.0)).alias("reward"),
        F.max_by(F.when(is_act, F.col(score_col)), F.when(is_act, F.col(turn_col))).alias("score"),
        F.sum(F.when(is_act, F.aggregate(lp_col, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)).alias("lp_sum"),
        F.min(F.when(is_act, F.col("__lp_pos"))).alias("first_lp_pos"),
        F.count(F.when(is_act, 1)).alias("n_actions"),
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), is_act.alias("act"), F.col(ids_col).alias("ids"),
                                             F.col(lp_col).cast("array<double>").alias("lps")))).alias("__turns"))
    none = F.array().cast("array<double>")

    def step(st, e):
        n = st["n"] + F.coalesce(F.size(e["ids"]), F.lit(0))
        lps = F.when(e["act"], F.concat(st["lps"], F.coalesce(e["lps"], none))).otherwise(st["lps"])
        seen = st["seen"] | e["act"]
        # turns before the first action add no values
        pad = F.when(seen, F.greatest(n - F.size(lps), F.lit(0))).otherwise(F.lit(0))
        return F.struct(n.alias("n"), seen.alias("seen"), F.concat(lps, F.array_repeat(F.lit(0.0), pad)).alias("lps"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("seen"), none.alias("lps"))
    return per.select("*", F.flatten(F.transform("__turns", lambda e: e["ids"])).alias("observation_tokens"),
                      F.aggregate("__turns", start, step)["lps"].alias("rollout_log_probs")).drop("__turns")


def single_turn_output(prompt_ids: Column, action_ids: Column, action_lps: Column, finish_reason: Column,
                       max_length: int, max_tokens: int) -> Column:
    """the prompt keeps its last ``max_length - max_tokens`` tokens;
    observation = prompt ++ action; one action span; truncated when the
    finish reason is 'length'; rollout log-probs are 0.0 on the prompt and a
    missing action value counts as 0.0."""
    keep = max_length - max_tokens
    p = F.when(F.size(prompt_ids) > keep, F.slice(prompt_ids, F.size(prompt_ids) - keep + 1, keep)).otherwise(prompt_ids)
    obs = F.concat(p, action_ids)
    lps = F.concat(F.array_repeat(F.lit(0.0), F.size(p)), F.transform(action_lps, lambda x: F.coalesce(x, F.lit(0.0))))
    return F.struct(obs.alias("observation_tokens"),
                    F.array(F.struct(F.size(p).alias("start"), F.size(obs).alias("end"))).alias("action_ranges"),
                    (finish_reason == "length").alias("truncated"), lps.alias("rollout_log_probs"))
