"""Query keys over rollouts and code-eval outcomes: evaluation metrics (A1-A4,
A12), group shaping (W1-W4, W12), sample expansion (P14), dynamic filter (P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.operators import advantage as adv
from posttrain.operators import metrics as met
from posttrain.operators.index import global_index
from posttrain.operators import routing as rt
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

R = ("fx_rollouts",)
O = ("fx_outcomes",)


@query("pass_at_k", """
SELECT k, round(avg(p), 6) AS pass_at_k FROM (
  SELECT k.k, t.n,
    CASE WHEN t.n - t.c < k.k THEN 1.0e0 WHEN t.c = 0 THEN 0.0e0
         ELSE 1.0e0 - list_product(list_transform(range(t.n - t.c + 1, t.n + 1), lambda i: 1.0e0 - k.k / i)) END AS p
  FROM (SELECT task_id, count(*) AS n, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS c FROM fx_outcomes GROUP BY task_id) t,
       (SELECT unnest([1, 10, 100]) AS k) k) x
GROUP BY k HAVING min(n) >= k""", O)
def q_pass_at_k(spark, sf):
    r = met.pass_at_k(fx.fx_outcomes(spark, sf))
    return r.select("k", rnd("pass_at_k").alias("pass_at_k"))


@query("task_tally", """
SELECT task_id, count(*) AS n_total, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS n_passed
FROM fx_outcomes GROUP BY task_id""", O)
def q_task_tally(spark, sf):
    return met.task_tally(fx.fx_outcomes(spark, sf))


@query("eval_by_datasource", """
SELECT datasource, count(*) AS n_prompts, round(avg(mx), 6) AS pass4, round(avg(mn), 6) AS pass1
FROM (SELECT group_id, arg_min(datasource, sample_idx) AS datasource, max(reward) AS mx, avg(reward) AS mn
      FROM fx_rollouts GROUP BY group_id) g
GROUP BY datasource""", R)
def q_eval_by_datasource(spark, sf):
    r = met.eval_by_datasource(fx.fx_rollouts(spark, sf), n_samples=fx.GROUP_SIZE)
    return r.select("datasource", "n_prompts", rnd("pass4").alias("pass4"), rnd("pass1").alias("pass1"))


@query("reward_stats_by_datasource", """
SELECT datasource, round(avg(r), 6) AS mean_reward, count(*) AS count,
       CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed
FROM (SELECT datasource, raw_score - 0.3e0 AS r FROM fx_rollouts) x GROUP BY datasource""", R)
def q_reward_stats(spark, sf):
    s = fx.fx_rollouts(spark, sf).select("datasource", (F.col("raw_score") - F.lit(0.3)).alias("r"))
    r = met.reward_stats_by_datasource(s, reward_col="r")
    return r.select("datasource", rnd("mean_reward").alias("mean_reward"), "count", "passed")


@query("group_baseline", """
SELECT sample_id, round(reward - avg(reward) OVER (PARTITION BY group_id), 6) AS advantage FROM fx_rollouts""", R)
def q_group_baseline(spark, sf):
    d = adv.group_shaping(fx.fx_rollouts(spark, sf), "reinforce_baseline", out="advantage")
    return d.select("sample_id", rnd("advantage").alias("advantage"))


@query("rloo_baseline", """
SELECT sample_id, round(reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1), 6) AS advantage
FROM fx_rollouts WINDOW w AS (PARTITION BY group_id)""", R)
def q_rloo(spark, sf):
    d = adv.group_shaping(fx.fx_rollouts(spark, sf), "rloo", out="advantage")
    return d.select("sample_id", rnd("advantage").alias("advantage"))


@query("group_norm", """
SELECT sample_id, round((raw_score - avg(raw_score) OVER w) / (stddev_samp(raw_score) OVER w + 1e-9), 6) AS advantage
FROM fx_rollouts WINDOW w AS (PARTITION BY group_id)""", R)
def q_group_norm(spark, sf):
    d = adv.group_shaping(fx.fx_rollouts(spark, sf), "group_norm", reward_col="raw_score", out="advantage")
    return d.select("sample_id", rnd("advantage").alias("advantage"))


@query("group_reward_std", """
SELECT sample_id, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(raw_score) OVER w END, 6) AS group_reward_std
FROM fx_rollouts WINDOW w AS (PARTITION BY group_id)""", R)
def q_group_reward_std(spark, sf):
    d = adv.group_reward_std(fx.fx_rollouts(spark, sf), reward_col="raw_score")
    return d.select("sample_id", rnd("group_reward_std").alias("group_reward_std"))


@query("groups_by_position", """
SELECT event_id, seq, seq // 4 AS group_id FROM (
  SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events) x""")
def q_groups_by_position(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    d = global_index(ev, "event_id", out="seq")
    return d.select("event_id", "seq", F.floor(F.col("seq") / 4).cast("long").alias("group_id"))


@query("expand_n_samples", """
SELECT doc_id AS prompt_id, s.sample_idx, lang AS datasource, text AS prompt, source AS label
FROM documents, (SELECT CAST(unnest(range(4)) AS INT) AS sample_idx) s""")
def q_expand(spark, sf):
    from posttrain.operators.sft import expand_n_samples
    p = table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("lang").alias("datasource"),
        F.col("text").alias("prompt"), F.col("source").alias("label"))
    return expand_n_samples(p, 4)


@query("dynamic_filter", """
SELECT sample_id, group_id FROM fx_rollouts
WHERE group_id IN (SELECT group_id FROM fx_rollouts GROUP BY group_id
                   HAVING count(*) = 4 AND avg(raw_score) > 0.2e0 + 1e-6 AND avg(raw_score) < 0.6e0 - 1e-6)""", R)
def q_dynamic_filter(spark, sf):
    d = rt.dynamic_filter(fx.fx_rollouts(spark, sf), fx.GROUP_SIZE, (0.2, 0.6), score_col="raw_score")
    return d.select("sample_id", "group_id")


@query("filter_pass_rate", """
SELECT n_seen, n_kept, round(n_kept * 100.0e0 / n_seen, 6) AS pass_rate FROM
 (SELECT count(*) AS n_seen FROM fx_rollouts) a,
 (SELECT count(*) AS n_kept FROM fx_rollouts WHERE group_id IN (SELECT group_id FROM fx_rollouts GROUP BY group_id
    HAVING count(*) = 4 AND avg(raw_score) > 0.2e0 + 1e-6 AND avg(raw_score) < 0.6e0 - 1e-6)) b""", R)
def q_filter_pass_rate(spark, sf):
    r = fx.fx_rollouts(spark, sf)
    kept = rt.dynamic_filter(r, fx.GROUP_SIZE, (0.2, 0.6), score_col="raw_score")
    return met.filter_pass_rate(r, kept).select("n_seen", "n_kept", rnd("pass_rate").alias("pass_rate"))
