"""Query keys for objectives and diagnostics over logged log-probs and logits
(M8-M26, A7, A8, J9, O7, O8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.operators import logits as lg
from posttrain.operators import objectives as ob
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

T = ("fx_tokens",)
P = ("fx_pairs",)
L = ("fx_logits",)


def _tokens_adv(spark, sf):
    return fx.fx_tokens(spark, sf).withColumn("advantages", F.col("teacher_log_prob") - F.col("base_log_prob"))


_ADV = "teacher_log_prob - base_log_prob"


def _ppo_sql(dual: float | None = None, tis: str | None = None) -> str:
    loss = "-least(s1, s2)" if dual is None else f"-CASE WHEN adv < 0 THEN greatest(least(s1, s2), {dual} * adv) ELSE least(s1, s2) END"
    w = ""
    if tis == "tis":
        w = "least(greatest(exp(old_log_prob - rollout_log_prob), 0.5e0), 5.0e0) * "
    elif tis == "icepop":
        w = ("CASE WHEN exp(old_log_prob - rollout_log_prob) BETWEEN 0.5e0 AND 5.0e0 "
             "THEN exp(old_log_prob - rollout_log_prob) ELSE 0.0e0 END * ")
    vk = (",\n  round(sum((rollout_log_prob - old_log_prob) * action_mask) / sum(action_mask), 6) AS rollout_kl"
          if tis else "")
    return f"""
, a AS (SELECT *, {_ADV} AS adv, exp(log_prob - old_log_prob) AS ratio, log_prob - old_log_prob AS lr FROM fx_tokens),
b AS (SELECT *, ratio * adv AS s1, least(greatest(ratio, 0.8e0), 1.2e0) * adv AS s2 FROM a)
SELECT round(sum({w}({loss}) * action_mask) / sum(action_mask), 6) AS loss,
  round(sum(CASE WHEN s2 < s1 THEN 1.0e0 ELSE 0.0e0 END * action_mask) / sum(action_mask), 6) AS clip_ratio,
  round(sum(-lr * action_mask) / sum(action_mask), 6) AS ppo_kl{vk} FROM b"""


def _round_all(df):
    return df.select(*[rnd(c).alias(c) for c in df.columns])


@query("ppo_policy_loss", _ppo_sql(), T)
def q_ppo_policy_loss(spark, sf):
    return _round_all(ob.policy_loss(_tokens_adv(spark, sf)))


@query("dual_clip", _ppo_sql(dual=3.0), T)
def q_dual_clip(spark, sf):
    return _round_all(ob.policy_loss(_tokens_adv(spark, sf), dual_clip=3.0))


@query("truncated_is", _ppo_sql(tis="tis"), T)
def q_truncated_is(spark, sf):
    return _round_all(ob.policy_loss(_tokens_adv(spark, sf), is_correction="tis"))


@query("icepop", _ppo_sql(tis="icepop"), T)
def q_icepop(spark, sf):
    return _round_all(ob.policy_loss(_tokens_adv(spark, sf), is_correction="icepop"))


@query("gspo_loss", f"""
, a AS (SELECT *, {_ADV} AS adv, log_prob - old_log_prob AS lr FROM fx_tokens),
b AS (SELECT *, exp(sum(lr * action_mask) OVER (PARTITION BY sample_id) / nullif(sum(action_mask) OVER (PARTITION BY sample_id), 0)) * action_mask AS ratio FROM a),
c AS (SELECT *, ratio * adv AS s1, least(greatest(ratio, 0.8e0), 1.2e0) * adv AS s2 FROM b),
per AS (SELECT sample_id, sum(-least(s1, s2) * action_mask) / nullif(sum(action_mask), 0) AS l FROM c GROUP BY sample_id)
SELECT round((SELECT avg(l) FROM per), 6) AS loss,
  round(sum(CASE WHEN s2 < s1 THEN 1.0e0 ELSE 0.0e0 END * action_mask) / sum(action_mask), 6) AS clip_ratio,
  round(sum(-lr * action_mask) / sum(action_mask), 6) AS ppo_kl FROM c""", T)
def q_gspo_loss(spark, sf):
    return _round_all(ob.policy_loss(_tokens_adv(spark, sf), loss_type="gspo"))


@query("loss_reduction", """
SELECT round(avg(l), 6) AS loss FROM (SELECT sample_id, sum(-log_prob * action_mask) / nullif(sum(action_mask), 0) AS l
  FROM fx_tokens GROUP BY sample_id) x""", T)
def q_loss_reduction(spark, sf):
    """M12 sequence level: mean of per-sample masked means (empty masks skipped)."""
    return _round_all(ob.sft_loss(fx.fx_tokens(spark, sf), token_level=False))


@query("sft_loss", """
SELECT round(sum(-log_prob * action_mask) / sum(action_mask), 6) AS loss FROM fx_tokens""", T)
def q_sft_loss(spark, sf):
    return _round_all(ob.sft_loss(fx.fx_tokens(spark, sf)))


@query("value_loss", """
, a AS (SELECT *, old_log_prob + least(greatest(log_prob - old_log_prob, -0.2e0), 0.2e0) AS vc FROM fx_tokens)
SELECT round(0.5e0 * sum(greatest(power(vc - teacher_log_prob, 2), power(log_prob - teacher_log_prob, 2)) * action_mask)
  / sum(action_mask), 6) AS loss FROM a""", T)
def q_value_loss(spark, sf):
    d = ob.value_loss(fx.fx_tokens(spark, sf), "log_prob", "old_log_prob", "teacher_log_prob", clip_eps=0.2)
    return _round_all(d)


@query("pairwise_loss", """
SELECT round(avg(ln(1 + exp(-(chosen - rejected - 0.1e0)))), 6) AS loss FROM fx_pairs""", P)
def q_pairwise_loss(spark, sf):
    p = fx.fx_pairs(spark, sf).withColumn("margin", F.lit(0.1))
    return _round_all(ob.pairwise_loss(p, margin="margin"))


@query("logexp_loss", """
SELECT round(avg(ln(1 + exp(rejected - chosen))), 6) AS loss FROM fx_pairs""", P)
def q_logexp_loss(spark, sf):
    return _round_all(ob.logexp_loss(fx.fx_pairs(spark, sf)))


_PAIR4 = """
, q AS (SELECT prompt_id, chosen AS policy_chosen, rejected AS policy_rejected,
          chosen * 0.9e0 AS reference_chosen, rejected * 1.1e0 AS reference_rejected FROM fx_pairs)"""


def _pairs4(spark, sf):
    p = fx.fx_pairs(spark, sf)
    return p.select("prompt_id", F.col("chosen").alias("policy_chosen"), F.col("rejected").alias("policy_rejected"),
                    (F.col("chosen") * 0.9).alias("reference_chosen"), (F.col("rejected") * 1.1).alias("reference_rejected"))


@query("dpo_loss", _PAIR4 + """,
l AS (SELECT *, (policy_chosen - policy_rejected) - (reference_chosen - reference_rejected) AS lg FROM q)
SELECT round(avg(ln(1 + exp(-0.1e0 * lg)) * 0.9e0 + ln(1 + exp(0.1e0 * lg)) * 0.1e0), 6) AS loss,
  round(sum(0.1e0 * (policy_chosen - reference_chosen)), 6) AS chosen_reward_sum,
  round(sum(0.1e0 * (policy_rejected - reference_rejected)), 6) AS rejected_reward_sum FROM l""", P)
def q_dpo_loss(spark, sf):
    rewards, loss = ob.dpo(_pairs4(spark, sf), beta=0.1, label_smoothing=0.1)
    r = rewards.agg(F.struct(F.sum("chosen_reward").alias("c"), F.sum("rejected_reward").alias("r"))).scalar()
    return loss.select(rnd("loss").alias("loss"), rnd(r["c"]).alias("chosen_reward_sum"),
                       rnd(r["r"]).alias("rejected_reward_sum"))


@query("ipo_loss", _PAIR4 + """
SELECT round(avg(power((policy_chosen - policy_rejected) - (reference_chosen - reference_rejected) - 1 / (2 * 0.1e0), 2)), 6) AS loss FROM q""", P)
def q_ipo_loss(spark, sf):
    _, loss = ob.dpo(_pairs4(spark, sf), beta=0.1, ipo=True)
    return _round_all(loss)


@query("kto_vanilla_loss", _PAIR4 + """,
k AS (SELECT greatest(avg(policy_chosen - reference_chosen), 0) AS ckl, greatest(avg(policy_rejected - reference_rejected), 0) AS rkl FROM q)
SELECT round((sum(1 - 1 / (1 + exp(-0.1e0 * ((policy_chosen - reference_chosen) - rkl))))
            + sum(1 - 1 / (1 + exp(-0.1e0 * (ckl - (policy_rejected - reference_rejected)))))) / (2 * count(*)), 6) AS loss FROM q, k""", P)
def q_kto_vanilla_loss(spark, sf):
    return _round_all(ob.kto_vanilla(_pairs4(spark, sf), beta=0.1))


@query("kto_loss", """
, ch AS (SELECT o_totalprice / 100000.0e0 AS policy, o_totalprice / 110000.0e0 AS reference FROM orders WHERE o_orderstatus = 'F'),
rj AS (SELECT o_totalprice / 100000.0e0 AS policy, o_totalprice / 90000.0e0 AS reference FROM orders WHERE o_orderstatus = 'O'),
kr AS (SELECT o_custkey % 4 AS rank, o_totalprice / 100000.0e0 AS policy, o_totalprice / 120000.0e0 AS reference FROM orders),
k AS (SELECT greatest(avg(m), 0) AS kl FROM (SELECT rank, avg(policy - reference) AS m FROM kr GROUP BY rank) x),
u AS (SELECT 1.0e0 * (1 - 1 / (1 + exp(-0.1e0 * ((policy - reference) - kl)))) AS l FROM ch, k
      UNION ALL SELECT 1.33e0 * (1 - 1 / (1 + exp(-0.1e0 * (kl - (policy - reference))))) AS l FROM rj, k)
SELECT round(avg(l), 6) AS loss, round((SELECT kl FROM k), 6) AS kl FROM u""")
def q_kto_loss(spark, sf):
    o = table(spark, sf, "orders")
    ch = o.filter(F.col("o_orderstatus") == "F").select((F.col("o_totalprice") / 100000.0).alias("policy"),
                                                        (F.col("o_totalprice") / 110000.0).alias("reference"))
    rj = o.filter(F.col("o_orderstatus") == "O").select((F.col("o_totalprice") / 100000.0).alias("policy"),
                                                        (F.col("o_totalprice") / 90000.0).alias("reference"))
    kr = o.select((F.col("o_custkey") % 4).alias("rank"), (F.col("o_totalprice") / 100000.0).alias("policy"),
                  (F.col("o_totalprice") / 120000.0).alias("reference"))
    return _round_all(ob.kto(ch, rj, kr, beta=0.1, desirable_weight=1.0, undesirable_weight=1.33))


@query("zscore_reward", """
SELECT sample_id, round((raw_score - 0.5e0) / 0.25e0, 6) AS reward FROM fx_rollouts""", ("fx_rollouts",))
def q_zscore_reward(spark, sf):
    r = fx.fx_rollouts(spark, sf)
    return r.select("sample_id", rnd(ob.zscore_reward(F.col("raw_score"), 0.5, 0.25)).alias("reward"))


@query("total_loss", _ppo_sql().replace("SELECT round(sum(", "SELECT round(0.5e0 * (sum(", 1).replace(
    "/ sum(action_mask), 6) AS loss,", "/ sum(action_mask) + 0.01e0 * sum((log_prob - base_log_prob) * action_mask) / sum(action_mask)"
    " - 0.001e0 * avg(-log_prob)), 6) AS loss,", 1), T)
def q_total_loss(spark, sf):
    t = _tokens_adv(spark, sf)
    pol = ob.policy_loss(t)
    m = F.col("action_mask").cast("double")
    kl = t.agg(F.struct((F.sum((F.col("log_prob") - F.col("base_log_prob")) * m) / F.sum(m)).alias("kl_loss"),
                        F.avg(-F.col("log_prob")).alias("ent"))).scalar()
    d = pol
    return d.select(rnd(ob.total_loss(F.col("loss"), kl["kl_loss"], kl["ent"], 0.01, 0.001, F.lit(0.5))).alias("loss"),
                    rnd("clip_ratio").alias("clip_ratio"), rnd("ppo_kl").alias("ppo_kl"))


@query("metric_mean", """
SELECT event_type AS metric, round(avg(v), 6) AS mean FROM (
  SELECT event_type, event_id // 100 AS mb, avg(value) AS v FROM events GROUP BY event_type, event_id // 100) x GROUP BY event_type""")
def q_metric_mean(spark, sf):
    e = table(spark, sf, "events")
    per_mb = e.groupBy(F.col("event_type").alias("metric"), F.floor(F.col("event_id") / 100).alias("mb")).agg(
        F.avg("value").alias("value"))
    return ob.metric_mean(per_mb).select("metric", rnd("mean").alias("mean"))


@query("all_reduce", """
SELECT event_type AS metric, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(sum(v), 6) AS sum FROM (
  SELECT event_type, user_id % 8 AS rank, avg(value) AS v FROM events GROUP BY event_type, user_id % 8) x GROUP BY event_type""")
def q_all_reduce(spark, sf):
    e = table(spark, sf, "events")
    per_rank = e.groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 8).alias("rank")).agg(
        F.avg("value").alias("value"))
    d = ob.all_reduce(per_rank)
    return d.select("metric", rnd("mean").alias("mean"), rnd("max").alias("max"), rnd("sum").alias("sum"))


@query("pair_join", """
SELECT o_custkey AS prompt_id, arg_max(o_orderkey, o_totalprice) AS chosen_o_orderkey,
  arg_min(o_orderkey, o_totalprice) AS rejected_o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def q_pair_join(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "prompt_id")
    return ob.pair_join(o, "prompt_id", "o_totalprice", ["o_orderkey"])


# ------------------------------------------------------------------ logits

_LSE = """
, x AS (SELECT vec_id, label, list_transform(logits, lambda v: CAST(v AS DOUBLE)) AS lg FROM fx_logits),
y AS (SELECT *, list_max(lg) AS m FROM x),
z AS (SELECT *, m + ln(list_sum(list_transform(lg, lambda v: exp(v - m)))) AS lse FROM y)"""


@query("token_logprob", _LSE.replace("list_transform(logits, lambda v: CAST(v AS DOUBLE))",
                                     "list_transform(logits, lambda v: CAST(v AS DOUBLE) / 0.7e0)") + """
SELECT vec_id, round(lg[label + 1] - lse, 6) AS log_prob FROM z""", L)
def q_token_logprob(spark, sf):
    d = fx.fx_logits(spark, sf)
    return d.select("vec_id", rnd(lg.token_logprob(F.col("logits"), F.col("label"), 0.7)).alias("log_prob"))


@query("entropy", _LSE + """
SELECT vec_id, round(lse - list_sum(list_transform(lg, lambda v: exp(v - lse) * v)), 6) AS entropy FROM z""", L)
def q_entropy(spark, sf):
    d = fx.fx_logits(spark, sf)
    return d.select("vec_id", rnd(lg.entropy(F.col("logits"))).alias("entropy"))


@query("lm_cross_entropy", _LSE + """,
n AS (SELECT *, lead(CASE WHEN label = 9 THEN -100 ELSE label END) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS nx FROM z)
SELECT round(avg(CASE WHEN nx <> -100 THEN lse - lg[nx + 1] END), 6) AS loss FROM n WHERE nx IS NOT NULL""", L)
def q_lm_cross_entropy(spark, sf):
    d = fx.fx_logits(spark, sf).withColumn("seq", (F.col("vec_id") / 10).cast("long")).withColumn(
        "label", F.when(F.col("label") == 9, F.lit(-100)).otherwise(F.col("label")))
    return _round_all(lg.lm_cross_entropy(d, "seq", "vec_id"))


@query("kd_cross_entropy", """
, x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 3) AS s,
          list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE) * 2) AS t FROM embeddings),
y AS (SELECT *, list_max(s) AS ms, list_max(t) AS mt FROM x),
z AS (SELECT *, ms + ln(list_sum(list_transform(s, lambda v: exp(v - ms)))) AS ls,
             mt + ln(list_sum(list_transform(t, lambda v: exp(v - mt)))) AS lt FROM y),
w AS (SELECT *, list_sum(list_transform(list_zip(t, s), lambda p: exp(p[1] - lt) * (p[2] - ls))) AS xv FROM z)
SELECT round(-sum(CASE WHEN label <> 3 THEN xv ELSE 0 END) / sum(CASE WHEN label <> 3 THEN 1 ELSE 0 END), 6) AS loss FROM w""")
def q_kd_cross_entropy(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select(F.transform("embedding", lambda v: v.cast("double") * 3).alias("s"),
                 F.transform(F.reverse("embedding"), lambda v: v.cast("double") * 2).alias("t"),
                 F.when(F.col("label") == 3, F.lit(-100)).otherwise(F.col("label")).alias("label"))
    return _round_all(lg.kd_cross_entropy(d, "s", "t", "label"))


@query("step_label_loss", """
, x AS (SELECT CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[6] AS DOUBLE) AS b,
          CASE WHEN embedding[1] > 0 THEN 0 ELSE 1 END AS y FROM embeddings WHERE label = 7),
z AS (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lse FROM x)
SELECT round(avg(lse - CASE WHEN y = 0 THEN a ELSE b END), 6) AS loss,
  round(avg(CASE WHEN (CASE WHEN b > a THEN 1 ELSE 0 END) = y THEN 1.0e0 ELSE 0.0e0 END), 6) AS acc FROM z""")
def q_step_label_loss(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select("label", "embedding", F.when(F.element_at("embedding", 1) > 0, F.lit(2)).otherwise(F.lit(5)).alias("y"))
    return _round_all(lg.step_label_loss(d, "label", "embedding", "y", 7, (2, 5)))


@query("topk_gate", """
, x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS lg FROM embeddings),
r AS (SELECT vec_id, unnest(range(1, len(lg) + 1)) AS i, unnest(lg) AS v FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM r),
t AS (SELECT * FROM k WHERE rk <= 2),
s0 AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS mx FROM t),
s AS (SELECT *, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY vec_id) AS w FROM s0)
SELECT vec_id, CAST(rk - 1 AS INT) AS rank, CAST(i - 1 AS INT) AS expert, round(w, 6) AS weight FROM s""")
def q_topk_gate(spark, sf):
    e = table(spark, sf, "embeddings")
    g = e.select("vec_id", lg.topk_gate(F.col("embedding"), 2).alias("gate"))
    return g.select("vec_id", F.posexplode("gate").alias("rank", "g")).select(
        "vec_id", "rank", F.col("g.idx").alias("expert"), rnd("g.weight").alias("weight"))


@query("expert_capacity", """
, x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS lg FROM embeddings),
r AS (SELECT vec_id, unnest(range(1, len(lg) + 1)) AS i, unnest(lg) AS v FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM r),
t AS (SELECT vec_id, i - 1 AS expert FROM k WHERE rk <= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY vec_id) - 1 AS pos FROM t)
SELECT vec_id, CAST(expert AS INT) AS expert, pos AS pos_in_expert FROM p
WHERE pos < floor((SELECT count(*) FROM embeddings) * 2 / 64.0 * 1.25)""")
def q_expert_capacity(spark, sf):
    e = table(spark, sf, "embeddings")
    g = e.select("vec_id", lg.topk_gate(F.col("embedding"), 2).alias("gate"))
    d = lg.expert_capacity(g, 64, 2, 1.25, "vec_id", bounds=e.select("vec_id"))
    return d.select("vec_id", "expert", "pos_in_expert")


@query("step_label_loss_soft", """
, x AS (SELECT CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[6] AS DOUBLE) AS b,
          1 / (1 + exp(-CAST(embedding[1] AS DOUBLE) * 10)) AS p FROM embeddings WHERE label = 7),
z AS (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lse FROM x)
SELECT round(avg(-(p * (a - lse) + (1 - p) * (b - lse))), 6) AS loss,
  round(avg(CASE WHEN (CASE WHEN b > a THEN 1 ELSE 0 END) = (CASE WHEN 1 - p > p THEN 1 ELSE 0 END) THEN 1.0e0 ELSE 0.0e0 END), 6) AS acc FROM z""")
def q_step_label_loss_soft(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select("label", "embedding",
                 (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.element_at("embedding", 1).cast("double") * 10))).alias("p"))
    return _round_all(lg.step_label_loss_soft(d, "label", "embedding", "p", 7, (2, 5)))


@query("topk_gate_noisy", """
, x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS lg,
          list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE)) AS nz FROM embeddings),
y AS (SELECT vec_id, list_transform(range(1, len(lg) + 1), lambda i: lg[i] + nz[i] * (ln(1 + exp(-abs(lg[i] * 0.5e0))) + greatest(lg[i] * 0.5e0, 0))) AS v FROM x),
r AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM r),
t AS (SELECT * FROM k WHERE rk <= 2),
s0 AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS mx FROM t),
s AS (SELECT *, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY vec_id) AS w FROM s0)
SELECT vec_id, CAST(rk - 1 AS INT) AS rank, CAST(i - 1 AS INT) AS expert, round(w, 6) AS weight FROM s""")
def q_topk_gate_noisy(spark, sf):
    """O7 noisy variant: the noise is a given column (the reversed row here),
    scaled by softplus of the noise logits (half the logits here)."""
    e = table(spark, sf, "embeddings")
    g = e.select("vec_id", lg.topk_gate(F.col("embedding"), 2, noise=F.reverse("embedding"),
                                        noise_logits=F.transform("embedding", lambda v: v * 0.5)).alias("gate"))
    return g.select("vec_id", F.posexplode("gate").alias("rank", "g")).select(
        "vec_id", "rank", F.col("g.idx").alias("expert"), rnd("g.weight").alias("weight"))
