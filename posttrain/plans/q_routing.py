"""Query keys for reward routing, scatter joins and datasource statistics
(P18, P19, J1-J3, J6-J8, A5, A6, A20, U3, U4, F2, F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.functions import text as tx
from posttrain.operators import routing as rt
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

R = ("fx_rollouts",)
TS = ("fx_tokens", "fx_token_samples")

# the reward registry used by the routing queries: datasource -> reward column
REGISTRY = {
    "click": lambda: F.when(F.col("raw_score") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)),
    "purchase": lambda: F.least(F.col("raw_score") * 2.0, F.lit(1.0)),
    "view": lambda: F.col("raw_score"),
}
DEFAULT_DS = "click"
KNOWN_OTHER = ("signup",)
ROUTING = rt.Routing(kd="all", guide="view", skip="signup")

_SCORED_SQL = """
, n AS (SELECT *, CASE WHEN d0 IN ('click', 'purchase', 'signup', 'view') THEN d0 ELSE 'click' END AS ds_norm
        FROM (SELECT *, lower(regexp_replace(coalesce(nullif(datasource, ''), 'click'), '^\\s+|\\s+$', '', 'g')) AS d0
              FROM fx_rollouts) a),
sc AS (SELECT *, CASE WHEN ds_norm = 'signup' THEN NULL WHEN ds_norm IN ('click', 'purchase', 'view') THEN ds_norm
                      ELSE 'click' END AS reward_ds,
              CASE WHEN ds_norm = 'signup' THEN 1.0e0 ELSE 0.0e0 END AS kd_skip_reward FROM n),
scored AS (SELECT *, CASE reward_ds WHEN 'click' THEN CASE WHEN raw_score >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END
                                    WHEN 'purchase' THEN least(raw_score * 2.0e0, 1.0e0)
                                    WHEN 'view' THEN raw_score ELSE 0.0e0 END AS reward_new,
                  sample_id // 256 AS batch_id FROM sc)"""


def _scored(spark, sf):
    r = fx.fx_rollouts(spark, sf).drop("reward")
    return rt.score_by_datasource(r, REGISTRY, DEFAULT_DS, KNOWN_OTHER, ROUTING).withColumn(
        "batch_id", F.floor(F.col("sample_id") / 256).cast("long"))


@query("reward_registry", _SCORED_SQL + """
SELECT sample_id, ds_norm, reward_ds, kd_skip_reward, round(reward_new, 6) AS reward FROM scored""", R)
def q_reward_registry(spark, sf):
    d = _scored(spark, sf)
    return d.select("sample_id", "ds_norm", "reward_ds", "kd_skip_reward", rnd("reward").alias("reward"))


@query("normalize_datasource", """
SELECT event_id, CASE WHEN d IN ('click', 'purchase', 'signup', 'view') THEN d ELSE 'click' END AS ds_norm
FROM (SELECT event_id, lower(regexp_replace(coalesce(nullif(
        CASE WHEN value < 10 THEN '' WHEN value < 20 THEN NULL WHEN value < 30 THEN ' ' || upper(event_type) || chr(9)
             ELSE event_type END, ''), 'click'), '^\\s+|\\s+$', '', 'g')) AS d FROM events) x""")
def q_normalize_datasource(spark, sf):
    e = table(spark, sf, "events")
    raw = (F.when(F.col("value") < 10, F.lit("")).when(F.col("value") < 20, F.lit(None).cast("string"))
           .when(F.col("value") < 30, F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t")))
           .otherwise(F.col("event_type")))
    known = sorted(set(REGISTRY) | set(KNOWN_OTHER))
    return e.select("event_id", tx.normalize_datasource(raw, known, DEFAULT_DS).alias("ds_norm"))


@query("route_predicates", """
SELECT event_id, true AS kd_enabled, event_type = 'view' AS guide_enabled, event_type = 'signup' AS skip_reward,
  event_type IN ('click', 'view') AS kd_partial FROM events""")
def q_route_predicates(spark, sf):
    e = table(spark, sf, "events")
    ds = F.col("event_type")
    partial = rt.Routing(kd=" Click, view ,")
    return e.select("event_id", ROUTING.is_kd_enabled(ds).alias("kd_enabled"),
                    ROUTING.is_guide_enabled(ds).alias("guide_enabled"),
                    ROUTING.is_skip_reward(ds).alias("skip_reward"),
                    partial.is_kd_enabled(ds).alias("kd_partial"))


@query("datasource_logs", _SCORED_SQL + """,
c AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS b, count(*) OVER (PARTITION BY batch_id, reward_ds) AS nds FROM scored),
x AS (SELECT c.*, r.ds_name FROM c, (SELECT unnest(['click', 'purchase', 'view']) AS ds_name) r)
SELECT sample_id, ds_name,
  CASE WHEN reward_ds = ds_name THEN 1.0e0 ELSE 0.0e0 END AS ratio,
  round(CASE WHEN reward_ds = ds_name THEN reward_new ELSE 0.0e0 END, 6) AS reward_sum,
  round(CASE WHEN reward_ds = ds_name THEN reward_new * b / nds ELSE 0.0e0 END, 6) AS pass_rate
FROM x""", R)
def q_datasource_logs(spark, sf):
    d = rt.datasource_logs(_scored(spark, sf), sorted(REGISTRY))
    return d.select("sample_id", "ds_name", "ratio", rnd("reward_sum").alias("reward_sum"),
                    rnd("pass_rate").alias("pass_rate"))


@query("undiluted_pass_rate", _SCORED_SQL + """,
c AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS b FROM scored),
x AS (SELECT c.*, r.ds_name FROM c, (SELECT unnest(['click', 'purchase', 'view']) AS ds_name) r)
SELECT ds_name, round(sum(CASE WHEN reward_ds = ds_name THEN reward_new ELSE 0.0e0 END * b)
   / (sum(CASE WHEN reward_ds = ds_name THEN 1.0e0 ELSE 0.0e0 END * b) + 1e-8), 6) AS pass_rate
FROM x GROUP BY ds_name""", R)
def q_undiluted_pass_rate(spark, sf):
    d = rt.undiluted_pass_rate(rt.datasource_logs(_scored(spark, sf), sorted(REGISTRY)))
    return d.select("ds_name", rnd("pass_rate").alias("pass_rate"))


@query("reward_scatter", _SCORED_SQL + """
SELECT f.sample_id, coalesce(s.reward_new, 0.0e0) AS reward
FROM fx_rollouts f LEFT JOIN (SELECT * FROM scored WHERE reward_ds IS NOT NULL) s ON f.sample_id = s.sample_id""", R)
def q_reward_scatter(spark, sf):
    scored = _scored(spark, sf).filter(F.col("reward_ds").isNotNull())
    batch = fx.fx_rollouts(spark, sf).select("sample_id")
    return rt.reward_scatter(batch, scored, cols=("reward",)).select("sample_id", "reward")


@query("attach_rewards", _SCORED_SQL + """
SELECT f.sample_id, s.reward_new AS reward,
  coalesce(CASE WHEN s.reward_ds = 'view' THEN NULL ELSE s.reward_new * 0.5e0 END, s.reward_new) AS score
FROM fx_rollouts f JOIN (SELECT * FROM scored WHERE reward_ds IS NOT NULL) s ON f.sample_id = s.sample_id""", R)
def q_attach_rewards(spark, sf):
    s = _scored(spark, sf).filter(F.col("reward_ds").isNotNull()).select(
        "sample_id", "reward",
        F.when(F.col("reward_ds") == "view", F.lit(None).cast("double")).otherwise(F.col("reward") * 0.5).alias("score"))
    batch = fx.fx_rollouts(spark, sf).select("sample_id")
    return rt.attach_rewards(batch, s).select("sample_id", "reward", "score")


@query("teacher_route", """
SELECT f.sample_id,
  CASE WHEN coalesce(r.url, '') <> '' AND coalesce(r.model, '') <> '' THEN r.url ELSE 'http://teacher-default' END AS teacher_url,
  CASE WHEN coalesce(r.url, '') <> '' AND coalesce(r.model, '') <> '' THEN r.model ELSE 'base-model' END AS teacher_model
FROM fx_rollouts f LEFT JOIN (VALUES ('click', 'http://teacher-a', 'model-a'), ('view', '', 'model-b'),
                                    ('purchase', 'http://teacher-c', 'model-c')) r(datasource, url, model)
  ON lower(f.datasource) = r.datasource""", R)
def q_teacher_route(spark, sf):
    routes = {"click": ("http://teacher-a", "model-a"), "view": ("", "model-b"), "purchase": ("http://teacher-c", "model-c")}
    d = rt.teacher_route(fx.fx_rollouts(spark, sf), routes, "http://teacher-default", "base-model")
    return d.select("sample_id", "teacher_url", "teacher_model")


@query("skip_anti_kd_semi", """
SELECT sample_id FROM fx_rollouts f
WHERE f.datasource IN (SELECT d FROM (VALUES ('click'), ('view'), ('signup')) k(d))
  AND f.datasource NOT IN (SELECT d FROM (VALUES ('signup')) s(d))""", R)
def q_skip_anti_kd_semi(spark, sf):
    f = fx.fx_rollouts(spark, sf)
    routing = rt.Routing(kd="click,view,signup", skip="signup")
    ds = F.col("datasource")
    return f.filter(routing.is_kd_enabled(ds) & ~routing.is_skip_reward(ds)).select("sample_id")


_KD_SQL = """
, res AS (SELECT sample_id, list(teacher_log_prob ORDER BY t) AS tlp FROM fx_tokens GROUP BY sample_id)"""


@query("kd_scatter", _KD_SQL + """
SELECT s.sample_id, CASE WHEN r.tlp IS NULL THEN 1 ELSE len(r.tlp) END AS n_teacher,
  round(coalesce(list_sum(r.tlp), 0.0e0), 6) AS teacher_sum,
  CASE WHEN r.tlp IS NULL THEN 0.0e0 ELSE 1.0e0 END AS kd_mask
FROM fx_token_samples s LEFT JOIN (SELECT * FROM res WHERE sample_id IN
   (SELECT sample_id FROM fx_token_samples WHERE NOT skip)) r ON s.sample_id = r.sample_id""", TS)
def q_kd_scatter(spark, sf):
    from posttrain.operators.distill import kd_scatter
    tk = fx.fx_tokens(spark, sf)
    samples = fx.fx_token_samples(spark, sf)
    res = tk.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("t", "teacher_log_prob"))).alias("a"))
    res = res.select("sample_id", F.transform("a", lambda e: e["teacher_log_prob"]).alias("teacher_log_probs"))
    res = res.join(samples.filter(~F.col("skip")).select("sample_id"), "sample_id", "left_semi")
    d = kd_scatter(samples.select("sample_id"), res)
    return d.select("sample_id", F.size("teacher_log_probs").alias("n_teacher"),
                    rnd(F.aggregate("teacher_log_probs", F.lit(0.0), lambda a, v: a + v)).alias("teacher_sum"),
                    "kd_mask")


@query("guided_fallback", _KD_SQL + """
SELECT s.sample_id,
  CASE WHEN s.reward > 0 THEN 1.0e0 ELSE 0.0e0 END AS guide_applied,
  CASE WHEN NOT (s.reward > 0) THEN 1.0e0 ELSE 0.0e0 END AS guide_fallback,
  CASE WHEN s.reward > 0 OR NOT s.skip THEN 1.0e0 ELSE 0.0e0 END AS valid,
  round(CASE WHEN s.reward > 0 THEN list_sum(r.tlp) * 2 WHEN NOT s.skip THEN list_sum(r.tlp) ELSE 0.0e0 END, 6) AS teacher_sum
FROM fx_token_samples s JOIN res r ON s.sample_id = r.sample_id""", TS)
def q_guided_fallback(spark, sf):
    tk = fx.fx_tokens(spark, sf)
    samples = fx.fx_token_samples(spark, sf)
    res = tk.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("t", "teacher_log_prob"))).alias("a"))
    res = res.select("sample_id", F.transform("a", lambda e: e["teacher_log_prob"]).alias("tl"))
    batch = samples.join(res, "sample_id").select("sample_id")
    guided = samples.join(res, "sample_id").select(
        "sample_id", F.transform("tl", lambda v: v * 2).alias("teacher_log_probs"), (F.col("reward") > 0).alias("valid"))
    plain = samples.join(res, "sample_id").select(
        "sample_id", F.col("tl").alias("teacher_log_probs"), (~F.col("skip")).alias("valid"))
    d = rt.guided_fallback(batch, guided, plain)
    return d.select("sample_id", "guide_applied", "guide_fallback", "valid",
                    rnd(F.aggregate("teacher_log_probs", F.lit(0.0), lambda a, v: a + v)).alias("teacher_sum"))


@query("logs_by_shared_keys", """
SELECT key FROM (SELECT user_id AS chunk_id, event_type || '_' || CAST(CAST(floor(value / 25) AS INT) AS VARCHAR) AS key FROM events) x
GROUP BY key HAVING count(DISTINCT chunk_id) = (SELECT count(DISTINCT user_id) FROM events)""")
def q_logs_by_shared_keys(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("chunk_id"),
        F.concat(F.col("event_type"), F.lit("_"), F.floor(F.col("value") / 25).cast("int").cast("string")).alias("key"))
    return rt.shared_log_keys(e)


@query("route_sets", """
SELECT event_id, array_to_string(list_sort(list_intersect(k, g)), ',') AS guided,
  array_to_string(list_sort(list_intersect(k, s)), ',') AS pure_kd,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(k, g), s))), ',') AS known
FROM (SELECT event_id, [event_type, 'view', 'click'] AS k, ['view', 'signup'] AS g,
             CASE WHEN value < 50 THEN [event_type] ELSE ['purchase'] END AS s FROM events) x""")
def q_route_sets(spark, sf):
    e = table(spark, sf, "events")
    k = F.array(F.col("event_type"), F.lit("view"), F.lit("click"))
    g = F.array(F.lit("view"), F.lit("signup"))
    s = F.when(F.col("value") < 50, F.array("event_type")).otherwise(F.array(F.lit("purchase")))
    gi, pk, kn = rt.route_sets(k, g, s)
    return e.select("event_id", F.array_join(F.array_sort(gi), ",").alias("guided"),
                    F.array_join(F.array_sort(pk), ",").alias("pure_kd"), F.array_join(kn, ",").alias("known"))
