"""Query keys over token rows: KL, token rewards, returns, whitening, the
estimator family (M1-M7, W5-W8, W11, A9-A11, A21, M27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.operators import advantage as adv
from posttrain.operators import metrics as met
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd

T = ("fx_tokens",)
TS = ("fx_tokens", "fx_token_samples")
R = ("fx_rollouts",)

KL_COEF = 0.01


@query("approx_kl", """
SELECT sample_id, t,
  round(least(greatest(log_prob - base_log_prob, -10), 10), 6) AS kl_k1,
  round(least(greatest((log_prob - base_log_prob) * (log_prob - base_log_prob) / 2.0e0, -10), 10), 6) AS kl_k2,
  round(least(greatest(exp(-(log_prob - base_log_prob)) - 1.0e0 + (log_prob - base_log_prob), -10), 10), 6) AS kl_k3
FROM fx_tokens""", T)
def q_approx_kl(spark, sf):
    t = fx.fx_tokens(spark, sf)
    lp, b = F.col("log_prob"), F.col("base_log_prob")
    return t.select("sample_id", "t", *[rnd(adv.approx_kl(lp, b, k)).alias(f"kl_{k}") for k in ("k1", "k2", "k3")])


@query("clip_reward", """
SELECT sample_id, least(greatest(raw_score * 40.0e0 - 20.0e0, -10.0e0), 10.0e0) AS clipped FROM fx_rollouts""", R)
def q_clip_reward(spark, sf):
    r = fx.fx_rollouts(spark, sf)
    return r.select("sample_id", adv.clip_reward(F.col("raw_score") * 40.0 - 20.0).alias("clipped"))


@query("overlong_penalty", """
SELECT sample_id, round(CASE WHEN least(response_length - 300, 100) > 0
   THEN reward - least(response_length - 300, 100) / 100.0e0 * 0.5e0 ELSE reward END, 6) AS reward
FROM fx_rollouts""", R)
def q_overlong(spark, sf):
    r = fx.fx_rollouts(spark, sf)
    return r.select("sample_id", rnd(adv.overlong_penalty(F.col("reward"), F.col("response_length"),
                                                          400, 100, 0.5)).alias("reward"))


@query("last_valid_token", """
SELECT sample_id, coalesce(max(CASE WHEN action_mask = 1 THEN t END), max(t)) AS last_t
FROM fx_tokens GROUP BY sample_id""", T)
def q_last_valid(spark, sf):
    d = adv.last_valid_token(fx.fx_tokens(spark, sf))
    return d.select("sample_id", "last_t").distinct()


_TOKEN_REWARD_SQL = """
tk AS (SELECT *, least(greatest(log_prob - base_log_prob, -10), 10) AS kl,
         coalesce(max(CASE WHEN action_mask = 1 THEN t END) OVER (PARTITION BY sample_id),
                  max(t) OVER (PARTITION BY sample_id)) AS last_t FROM fx_tokens),
tr AS (SELECT tk.*, CASE WHEN t = last_t THEN coalesce(least(greatest(s.reward, -10.0e0), 10.0e0), 0.0e0)
                         ELSE 0.0e0 END - {coef} * kl AS token_reward
       FROM tk LEFT JOIN fx_token_samples s USING (sample_id))"""


@query("token_reward", ", " + _TOKEN_REWARD_SQL.format(coef=KL_COEF) + """
SELECT sample_id, t, round(token_reward, 6) AS token_reward FROM tr""", TS)
def q_token_reward(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("kl", adv.approx_kl(F.col("log_prob"), F.col("base_log_prob")))
    d = adv.token_reward(t, fx.fx_token_samples(spark, sf), KL_COEF, clip=(-10.0, 10.0))
    return d.select("sample_id", "t", rnd("token_reward").alias("token_reward"))


@query("return_sum", ", " + _TOKEN_REWARD_SQL.format(coef=KL_COEF) + """
SELECT sample_id, round(sum(token_reward), 6) AS "return" FROM tr GROUP BY sample_id""", TS)
def q_return_sum(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("kl", adv.approx_kl(F.col("log_prob"), F.col("base_log_prob")))
    d = adv.token_reward(t, fx.fx_token_samples(spark, sf), KL_COEF, clip=(-10.0, 10.0))
    return met.return_sum(d).select("sample_id", rnd("return").alias("return"))


@query("discounted_returns", """
SELECT a.sample_id, a.t, round(sum(power(0.9e0, b.t - a.t) * b.action_mask * b.log_prob), 6) AS returns
FROM fx_tokens a JOIN fx_tokens b ON a.sample_id = b.sample_id AND b.t >= a.t
GROUP BY a.sample_id, a.t""", T)
def q_discounted_returns(spark, sf):
    d = adv.discounted_returns(fx.fx_tokens(spark, sf), gamma=0.9, reward_col="log_prob")
    return d.select("sample_id", "t", rnd("returns").alias("returns"))


@query("undiscounted_returns", """
SELECT sample_id, t, round(sum(action_mask * log_prob) OVER (PARTITION BY sample_id ORDER BY t DESC
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS returns FROM fx_tokens""", T)
def q_undiscounted_returns(spark, sf):
    d = adv.discounted_returns(fx.fx_tokens(spark, sf), gamma=1.0, reward_col="log_prob")
    return d.select("sample_id", "t", rnd("returns").alias("returns"))


@query("whiten_advantages", """
, x AS (SELECT sample_id, t, action_mask, log_prob - base_log_prob AS v FROM fx_tokens),
mv AS (SELECT sum(v * action_mask) / sum(action_mask) AS mean FROM x),
vv AS (SELECT sum(power(v - mean, 2) * action_mask) / sum(action_mask) AS var FROM x, mv)
SELECT sample_id, t, round((v - mean) / sqrt(greatest(var, 1e-8)), 6) AS advantages FROM x, mv, vv""", T)
def q_whiten(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("advantages", F.col("log_prob") - F.col("base_log_prob"))
    return adv.whiten(t, "advantages").select("sample_id", "t", rnd("advantages").alias("advantages"))


@query("kd_advantage", """
, x AS (SELECT sample_id, t, action_mask, (teacher_log_prob - log_prob) * action_mask AS v FROM fx_tokens),
mv AS (SELECT sum(v * action_mask) / sum(action_mask) AS mean FROM x),
vv AS (SELECT sum(power(v - mean, 2) * action_mask) / sum(action_mask) AS var FROM x, mv)
SELECT sample_id, t, round((v - mean) / sqrt(greatest(var, 1e-8)), 6) AS advantages FROM x, mv, vv""", T)
def q_kd_advantage(spark, sf):
    d = adv.kd_advantage(fx.fx_tokens(spark, sf))
    return d.select("sample_id", "t", rnd("advantages").alias("advantages"))


@query("masked_mean", """
SELECT sample_id, round(sum(log_prob * action_mask) / nullif(sum(action_mask), 0), 6) AS masked_mean
FROM fx_tokens GROUP BY sample_id""", T)
def q_masked_mean(spark, sf):
    d = adv.masked_mean(fx.fx_tokens(spark, sf), "log_prob", "action_mask", by=["sample_id"])
    return d.select("sample_id", rnd("masked_mean").alias("masked_mean"))


@query("masked_normalize", """
, a AS (SELECT *, log_prob * action_mask AS xm FROM fx_tokens),
b AS (SELECT *, xm - sum(xm * action_mask) OVER w / nullif(sum(action_mask) OVER w, 0) AS c
      FROM a WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, t, round(c / sqrt(greatest(sum(c * c * action_mask) OVER (PARTITION BY sample_id)
       / nullif(sum(action_mask) OVER (PARTITION BY sample_id), 0), 1e-8)), 6) + 0.0e0 AS normalized FROM b""", T)
def q_masked_normalize(spark, sf):
    d = adv.masked_normalize(fx.fx_tokens(spark, sf), "log_prob")
    return d.select("sample_id", "t", rnd("normalized").alias("normalized"))


@query("length_weighted_kl", """
SELECT round(sum(kl * n) / nullif(sum(n), 0), 6) AS kl FROM (
  SELECT sample_id, sum((log_prob - base_log_prob) * action_mask) / nullif(sum(action_mask), 0) AS kl,
         sum(action_mask) AS n FROM fx_tokens GROUP BY sample_id) x""", T)
def q_length_weighted_kl(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("kl", F.col("log_prob") - F.col("base_log_prob"))
    per = adv.masked_mean(t, "kl", "action_mask", by=["sample_id"], out="kl").join(
        t.groupBy("sample_id").agg(F.sum("action_mask").alias("n")), "sample_id")
    return per.agg(rnd(F.sum(F.col("kl") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("kl"))


@query("position_ids", """
SELECT sample_id, t, CASE WHEN action_mask = 0 THEN 1 ELSE
  CAST(sum(action_mask) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) END AS position_id,
  greatest(CAST(sum(action_mask) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT), 0) AS packed_position_id
FROM fx_tokens""", T)
def q_position_ids(spark, sf):
    d = adv.position_ids(fx.fx_tokens(spark, sf), "action_mask")
    d = adv.position_ids(d, "action_mask", packed=True, out="packed_position_id")
    return d.select("sample_id", "t", F.col("position_id").cast("long").alias("position_id"),
                    F.col("packed_position_id").cast("long").alias("packed_position_id"))


@query("next_token_shift", """
SELECT sample_id, t, next_id FROM (
  SELECT sample_id, t, lead(CAST(round(-log_prob * 10) AS INT)) OVER (PARTITION BY sample_id ORDER BY t) AS next_id
  FROM fx_tokens) x WHERE next_id IS NOT NULL""", T)
def q_next_token_shift(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("id", F.round(-F.col("log_prob") * 10).cast("int"))
    return adv.next_token_shift(t, "id").select("sample_id", "t", "next_id")


@query("log_prob_mask", """
SELECT sample_id, t, log_prob * action_mask AS masked_log_prob FROM fx_tokens""", T)
def q_log_prob_mask(spark, sf):
    t = fx.fx_tokens(spark, sf)
    return t.select("sample_id", "t", (F.col("log_prob") * F.col("action_mask")).alias("masked_log_prob"))


def _estimator_sql(shape: str, whiten: bool, paired: bool = False, gamma: float = 1.0, overlay: float = 0.0) -> str:
    """The estimator family; ``paired`` ones refuse groups of one sample."""
    refused = "count(*) OVER w < 2" if paired else "false"
    returns = """sum(action_mask * token_reward) OVER (PARTITION BY sample_id ORDER BY t DESC
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    if gamma != 1.0:
        returns = f"""(SELECT sum(power({gamma}e0, b.t - tr.t) * b.action_mask * b.token_reward) FROM tr b
         WHERE b.sample_id = tr.sample_id AND b.t >= tr.t)"""
    adv = "returns"
    if overlay:
        kd = "(teacher_log_prob - log_prob) * action_mask"
        adv = f"""CASE WHEN NOT kd THEN returns WHEN skip THEN returns * (1 - 1.0e0) + 1.0e0 * {kd}
          ELSE returns * (1 - {overlay}e0) + {overlay}e0 * {kd} END"""
    base = f""", s AS (SELECT sample_id, {shape} AS reward, {refused} AS refused, skip, reward > 0 AS kd FROM fx_token_samples
             WINDOW w AS (PARTITION BY group_id)),
tk AS (SELECT *, least(greatest(log_prob - base_log_prob, -10), 10) AS kl,
         coalesce(max(CASE WHEN action_mask = 1 THEN t END) OVER (PARTITION BY sample_id),
                  max(t) OVER (PARTITION BY sample_id)) AS last_t FROM fx_tokens),
tr AS (SELECT tk.*, s.skip, s.kd, coalesce(s.refused, false) AS refused,
         CASE WHEN t = last_t AND s.reward IS NOT NULL THEN least(greatest(s.reward, -10.0e0), 10.0e0)
              ELSE 0.0e0 END - {KL_COEF} * kl AS token_reward
       FROM tk LEFT JOIN s USING (sample_id)),
r0 AS (SELECT *, CASE WHEN NOT refused THEN {returns} END AS returns FROM tr),
rt AS (SELECT *, {adv} AS adv FROM r0)"""
    if not whiten:
        return base + "\nSELECT sample_id, t, refused, round(adv, 6) AS advantages FROM rt"
    return base + """,
mv AS (SELECT sum(adv * action_mask) / sum(action_mask) AS mean FROM rt WHERE adv IS NOT NULL),
vv AS (SELECT sum(power(adv - mean, 2) * action_mask) / sum(action_mask) AS var FROM rt, mv WHERE adv IS NOT NULL)
SELECT sample_id, t, refused, round((adv - mean) / sqrt(greatest(var, 1e-8)), 6) AS advantages FROM rt, mv, vv"""


def _estimator(spark, sf, name, **options):
    samples = fx.fx_token_samples(spark, sf).withColumn("kd_mask", (F.col("reward") > 0).cast("double"))
    d = adv.estimator_advantages(samples, fx.fx_tokens(spark, sf), name, kl_coef=KL_COEF, **options)
    return d.select("sample_id", "t", F.col("error").isNotNull().alias("refused"), rnd("advantages").alias("advantages"))


@query("estimator_dispatch", _estimator_sql("reward - avg(reward) OVER w", True, paired=True), TS)
def q_estimator_dispatch(spark, sf):
    """reinforce_baseline: group mean baseline, then whitening."""
    return _estimator(spark, sf, "reinforce_baseline")


@query("estimator_rloo", _estimator_sql(
    "reward - (sum(reward) OVER w - reward) / nullif(count(*) OVER w - 1, 0)", False, paired=True), TS)
def q_estimator_rloo(spark, sf):
    return _estimator(spark, sf, "rloo")


@query("estimator_group_norm", _estimator_sql(
    "(reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-9)", False, paired=True), TS)
def q_estimator_group_norm(spark, sf):
    return _estimator(spark, sf, "group_norm")


@query("estimator_reinforce", _estimator_sql("reward + 0.0e0 * count(*) OVER w", True), TS)
def q_estimator_reinforce(spark, sf):
    return _estimator(spark, sf, "reinforce")


@query("estimator_reinforce_discounted", _estimator_sql("reward + 0.0e0 * count(*) OVER w", True, gamma=0.9), TS)
def q_estimator_reinforce_discounted(spark, sf):
    return _estimator(spark, sf, "reinforce", gamma=0.9)


@query("estimator_dr_grpo", _estimator_sql("reward - avg(reward) OVER w", False), TS)
def q_estimator_dr_grpo(spark, sf):
    """Group mean baseline without whitening; a sample alone in its group gets 0 as reward."""
    return _estimator(spark, sf, "dr_grpo", gamma=0.5)  # group estimators do not discount


@query("estimator_overlay", _estimator_sql("reward - avg(reward) OVER w", True, paired=True, overlay=0.3), TS)
def q_estimator_overlay(spark, sf):
    """reinforce_baseline with the distillation overlay before whitening."""
    return _estimator(spark, sf, "reinforce_baseline", kd_coef=0.3)


@query("estimator_kd", """
, x AS (SELECT sample_id, t, action_mask, (teacher_log_prob - log_prob) * action_mask AS v FROM fx_tokens),
mv AS (SELECT sum(v * action_mask) / sum(action_mask) AS mean FROM x),
vv AS (SELECT sum(power(v - mean, 2) * action_mask) / sum(action_mask) AS var FROM x, mv)
SELECT sample_id, t, false AS refused, round((v - mean) / sqrt(greatest(var, 1e-8)), 6) AS advantages FROM x, mv, vv""", TS)
def q_estimator_kd(spark, sf):
    return _estimator(spark, sf, "kd")


@query("hybrid_blend", """
, x AS (SELECT sample_id, t, action_mask, log_prob - old_log_prob AS adv,
          (teacher_log_prob - log_prob) * action_mask AS kd FROM fx_tokens)
SELECT x.sample_id, t, round(CASE WHEN s.reward <= 0.5e0 THEN adv
   WHEN s.skip THEN adv * (1 - 1.0e0) + 1.0e0 * kd
   ELSE adv * (1 - 0.3e0) + 0.3e0 * kd END, 6) + 0.0e0 AS advantages
FROM x JOIN fx_token_samples s USING (sample_id)""", TS)
def q_hybrid_blend(spark, sf):
    t = fx.fx_tokens(spark, sf).join(fx.fx_token_samples(spark, sf).select("sample_id", "skip", "reward"),
                                     "sample_id")
    kd = (F.col("teacher_log_prob") - F.col("log_prob")) * F.col("action_mask")
    a = adv.hybrid_blend(F.col("log_prob") - F.col("old_log_prob"), kd, F.col("reward"), F.col("skip"), 0.3)
    return t.select("sample_id", "t", rnd(a).alias("advantages"))
