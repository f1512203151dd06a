"""Query keys for the plug-in surface and logged agent trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posttrain.functions import text as tx
from posttrain.functions import udf
from posttrain.operators import agents
from posttrain.operators import routing as rt
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

RS = ("fx_responses",)


def label_match_reward(queries, prompts, labels, datasources=None, **_):
    """A plug-in reward: 1.0 when the label occurs in the response, with the
    response's word count as an extra log."""
    rewards = [1.0 if (lab and lab in q) else 0.0 for q, lab in zip(queries, labels)]
    words = [float(len(q.split())) for q in queries]
    return {"rewards": rewards, "scores": [r * 0.5 for r in rewards], "extra_logs": {"n_words": words}}


@query("reward_fn", """
SELECT doc_id, CASE WHEN contains(text, source) THEN 1.0e0 ELSE 0.0e0 END AS reward,
  CASE WHEN contains(text, source) THEN 0.5e0 ELSE 0.0e0 END AS score,
  CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS DOUBLE) AS n_words
FROM documents""")
def q_reward_fn(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"), F.lit("").alias("prompt"),
                                             F.col("source").alias("label"), F.col("lang").alias("datasource"))
    r = udf.apply_reward_func(d, label_match_reward, keep=("doc_id",))
    return r.select("doc_id", "reward", "score", F.col("extra")["n_words"].alias("n_words"))


class FlakyJudge:
    """A client stand-in: rejects texts with an umlaut, times out on texts
    with a sharp s (retried once, then an error row), accepts the rest."""

    def __call__(self, text):
        if "ß" in text:
            raise TimeoutError("judge timed out")
        return "ü" not in text


@query("batch_call", """
SELECT doc_id, CASE WHEN contains(text, 'ß') OR contains(text, 'ü') THEN 0.0e0 ELSE 1.0e0 END AS success,
  CASE WHEN contains(text, 'ß') THEN 'TimeoutError: judge timed out' END AS error FROM documents""")
def q_batch_call(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return udf.batch_call(d, FlakyJudge(), "text", "doc_id")


def _lang_reward(lang: str):
    """F4 factory entry: extract with the language's extractor; reward 1.0
    when a block was found and it is longer than 100 characters."""
    def build():
        code = tx.extract_code_last(F.col("response")) if lang == "python" else tx.extract_code_multi(F.col("response"))
        found = code != F.lit(tx.NO_BLOCK) if lang == "python" else code != tx.pystrip(F.col("response"))
        return F.when(found & (F.length(code) > 100), F.lit(1.0)).otherwise(F.lit(0.0))
    return build


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("language_reward_factory", f"""
, c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'js' WHEN 2 THEN 'cpp' ELSE 'ruby' END AS ds,
          coalesce({_STRIP.format(x="regexp_extract_all(response, '(?s)```(?:python|go|ts|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh)(.*?)```', 1)[-1]")}, 'raise') AS c1,
          {_STRIP.format(x="response")} AS whole,
          coalesce({_STRIP.format(x="regexp_extract_all(response, '(?s)```(?:python|go|rs|rust|ts|scala|d|r|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh|julia|swift|perl|lua|rkt|racket|rb|ruby)(.*?)```', 1)[-1]")}, {_STRIP.format(x="response")}) AS c2
        FROM fx_responses)
SELECT doc_id, CASE WHEN ds = 'python' THEN (CASE WHEN c1 <> 'raise' AND length(c1) > 100 THEN 1.0e0 ELSE 0.0e0 END)
                    ELSE (CASE WHEN c2 <> whole AND length(c2) > 100 THEN 1.0e0 ELSE 0.0e0 END) END AS reward FROM c""", RS)
def q_language_reward_factory(spark, sf):
    r = fx.fx_responses(spark, sf)
    langs = ["python", "js", "cpp", "ruby"]
    reg = udf.language_rewards(langs, _lang_reward)
    k = F.col("doc_id") % 4
    r = r.withColumn("datasource", F.when(k == 0, "python").when(k == 1, "js").when(k == 2, "cpp").otherwise("ruby"))
    d = rt.score_by_datasource(r, reg, default="python")
    return d.select("doc_id", "reward")


_WL = "list_transform(regexp_extract_all(text, '\\w+'), lambda x: CAST(length(x) AS INT))"


def _turn_ids(spark, sf):
    c = table(spark, sf, "conversations")
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))
    return c.select("conv_id", "turn", "role", ids.alias("ids"), F.length("text").alias("n_chars"))


@query("trajectory_assembly", f"""
, t AS (SELECT conv_id, turn, role, {_WL} AS ids, length(text) AS n_chars FROM conversations),
s AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t)
SELECT conv_id, CAST(sum(len(ids)) AS BIGINT) AS total_len,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_actions,
  coalesce(string_agg(CAST(st AS VARCHAR) || '-' || CAST(st + len(ids) AS VARCHAR), ';' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS spans,
  sum(CASE WHEN role = 'assistant' AND n_chars > 300 THEN 1.0e0 ELSE 0.0e0 END) AS reward,
  round(arg_max(len(ids) / 100.0e0, turn) FILTER (WHERE role = 'assistant'), 6) AS score,
  round(coalesce(sum(list_sum(list_transform(ids, lambda x: -x / 10.0e0))) FILTER (WHERE role = 'assistant'), 0.0e0), 6) + 0.0e0 AS lp_sum
FROM s GROUP BY conv_id""")
def q_trajectory_assembly(spark, sf):
    d = _turn_ids(spark, sf).select(
        "*", F.when(F.col("n_chars") > 300, 1.0).otherwise(0.0).alias("step_reward"),
        (F.size("ids") / F.lit(100.0)).alias("step_score"),
        F.transform("ids", lambda x: -x / F.lit(10.0)).alias("action_lps"))
    a = agents.trajectory_assembly(d)
    spans = F.array_join(F.transform("action_ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"),
                                                                        r["end"].cast("string"))), ";")
    return a.select("conv_id", F.col("total_len").cast("long").alias("total_len"), "n_actions", spans.alias("spans"),
                    "reward", rnd("score").alias("score"), rnd("lp_sum").alias("lp_sum"))


@query("trajectory_arrays", f"""
, t AS (SELECT conv_id, turn, role, {_WL} AS ids FROM conversations),
s AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
    min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first_act FROM t),
o AS (SELECT conv_id, any_value(first_act) AS first_act, sum(len(ids)) AS n, string_agg(array_to_string(ids, ','), ',' ORDER BY turn) FILTER (WHERE len(ids) > 0) AS obs FROM s GROUP BY conv_id),
v AS (SELECT conv_id, CASE WHEN turn = first_act THEN 0 ELSE st END + unnest(range(len(ids))) AS pos, -unnest(ids) AS tenths FROM s WHERE role = 'assistant'),
p AS (SELECT conv_id, unnest(range(CAST(n AS BIGINT))) AS pos FROM o WHERE first_act IS NOT NULL),
l AS (SELECT p.conv_id, string_agg(CAST(coalesce(tenths, 0) AS VARCHAR), ',' ORDER BY p.pos) AS lps FROM p LEFT JOIN v ON p.conv_id = v.conv_id AND p.pos = v.pos GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(obs, '') AS observation_tokens, coalesce(lps, '') AS rollout_tenths FROM o LEFT JOIN l USING (conv_id)""")
def q_trajectory_arrays(spark, sf):
    """F5's arrays: the observation's tokens, and the rollout log-probs beside them."""
    d = _turn_ids(spark, sf).select("*", F.lit(0.0).alias("step_reward"), F.lit(0.0).alias("step_score"),
                                    F.transform("ids", lambda x: -x / F.lit(10.0)).alias("action_lps"))
    a = agents.trajectory_assembly(d)
    tenths = F.transform("rollout_log_probs", lambda x: F.round(x * 10).cast("int").cast("string"))
    return a.select("conv_id", F.array_join(F.col("observation_tokens").cast("array<string>"), ",").alias("observation_tokens"),
                    F.array_join(tenths, ",").alias("rollout_tenths"))


@query("single_turn_output", f"""
, u AS (SELECT conv_id, turn, {_WL} AS p FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, {_WL} AS r FROM conversations WHERE role = 'assistant'),
pr AS (SELECT u.conv_id, u.turn, CASE WHEN len(p) > 40 THEN p[len(p) - 40 + 1:] ELSE p END AS p, r FROM u JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn)
SELECT conv_id, turn, CAST(len(p) + len(r) AS INT) AS n_obs, CAST(len(p) AS INT) AS span_start,
  len(r) >= 60 AS truncated,
  round(coalesce(list_sum(list_transform(r, lambda x: CASE WHEN x = 1 THEN 0.0e0 ELSE -x / 10.0e0 END)), 0.0e0), 6) + 0.0e0 AS lp_sum
FROM pr""")
def q_single_turn_output(spark, sf):
    c = _turn_ids(spark, sf)
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("ids").alias("p"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("r"))
    d = u.join(a, ["conv_id", "turn"])
    lps = F.transform("r", lambda x: F.when(x == 1, F.lit(None).cast("double")).otherwise(-x / F.lit(10.0)))
    finish = F.when(F.size("r") >= 60, F.lit("length")).otherwise(F.lit("stop"))
    o = agents.single_turn_output(F.col("p"), F.col("r"), lps, finish, max_length=100, max_tokens=60)
    d = d.select("conv_id", "turn", o.alias("o"))
    return d.select("conv_id", "turn", F.size("o.observation_tokens").alias("n_obs"),
                    F.element_at("o.action_ranges", 1)["start"].alias("span_start"),
                    F.col("o.truncated").alias("truncated"),
                    rnd(F.aggregate("o.rollout_log_probs", F.lit(0.0), lambda s, x: s + x)).alias("lp_sum"))
