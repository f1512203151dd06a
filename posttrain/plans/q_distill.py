"""Query keys for guided distillation and teacher diagnostics
(D1-D6, A14-A16, P24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.operators import distill as ds
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

T = ("fx_tokens",)
TS = ("fx_tokens", "fx_token_samples")

# token ids in these queries are word lengths, which both engines compute the same way
_IDS_SQL = """
, w AS (SELECT conv_id, turn, role,
          list_transform(regexp_extract_all(text, '\\w+'), lambda x: CAST(length(x) AS INT)) AS ids FROM conversations),
g AS (SELECT *, list_concat(ids, [9, 9]) AS prompt_ids,
             list_concat(list_concat(ids, [9, 9]), list_reverse(ids)) AS query_ids,
             CASE turn % 3 WHEN 0 THEN list_concat(ids, [9, 9]) WHEN 1 THEN list_concat(ids, [8]) ELSE [] END AS given,
             CASE WHEN role = 'system' THEN 3 ELSE 0 END AS hint FROM w),
b AS (SELECT *, CASE WHEN hint > 0 AND hint < len(query_ids) THEN hint
        ELSE (CASE WHEN len(given) = 0 THEN NULL
                   WHEN len(given) <= len(query_ids) AND query_ids[1:len(given)] = given THEN len(given)
                   ELSE coalesce(nullif(list_position(list_transform(range(1, least(len(query_ids), len(given)) + 1),
                                          lambda i: query_ids[i] = given[i]), false), 0) - 1,
                                 least(len(query_ids), len(given))) END) END AS p0 FROM g),
pb AS (SELECT *, CASE WHEN p0 > 0 THEN p0 END AS p_len FROM b)"""


def _ids(spark, sf):
    c = table(spark, sf, "conversations")
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))
    d = c.select("conv_id", "turn", "role", ids.alias("ids"))
    nine = F.array(F.lit(9), F.lit(9))
    d = d.select("*", F.concat("ids", nine).alias("prompt_ids"),
                 F.concat("ids", nine, F.reverse("ids")).alias("query_ids"),
                 F.when(F.col("turn") % 3 == 0, F.concat("ids", nine))
                 .when(F.col("turn") % 3 == 1, F.concat("ids", F.array(F.lit(8))))
                 .otherwise(F.array().cast("array<int>")).alias("given"),
                 F.when(F.col("role") == "system", 3).otherwise(0).alias("hint"))
    return d.withColumn("p_len", ds.prompt_boundary(F.col("query_ids"), F.col("given"), F.col("hint")))


@query("prompt_boundary", _IDS_SQL + """
SELECT conv_id, turn, CAST(p_len AS INT) AS p_len FROM pb""")
def q_prompt_boundary(spark, sf):
    return _ids(spark, sf).select("conv_id", "turn", F.col("p_len").cast("int").alias("p_len"))


_SPLICE_SQL = _IDS_SQL + """,
sp AS (SELECT *, query_ids[1:p_len] AS orig_p, query_ids[p_len + 1:] AS resp FROM pb WHERE p_len IS NOT NULL),
gp AS (SELECT *, CASE WHEN len(orig_p) >= 2 AND orig_p[len(orig_p) - 1:] = [9, 9]
                      THEN list_concat(list_concat(orig_p[1:len(orig_p) - 2], [7, 7, 7]), [9, 9]) END AS guided_p FROM sp),
gs AS (SELECT conv_id, turn, p_len, list_concat(guided_p, resp) AS ids2, len(guided_p) AS guided_len,
              len(guided_p) - p_len AS delta, len(query_ids) AS orig_len
       FROM gp WHERE guided_p IS NOT NULL AND len(guided_p) - p_len > 0)"""


def _splice(spark, sf):
    d = _ids(spark, sf)
    s = ds.guided_splice(F.col("query_ids"), F.col("p_len"), F.array(F.lit(7), F.lit(7), F.lit(7)),
                         F.array(F.lit(9), F.lit(9)))
    return d.select("conv_id", "turn", "p_len", s.alias("s")).filter(F.col("s").isNotNull()).select(
        "conv_id", "turn", "p_len", F.col("s.ids").alias("ids2"), F.col("s.guided_len").alias("guided_len"),
        F.col("s.delta").alias("delta"), F.col("s.orig_len").alias("orig_len"))


@query("guided_splice", _SPLICE_SQL + """
SELECT conv_id, turn, array_to_string(ids2, ',') AS ids, CAST(guided_len AS INT) AS guided_len,
  CAST(delta AS INT) AS delta, CAST(orig_len AS INT) AS orig_len FROM gs""")
def q_guided_splice(spark, sf):
    d = _splice(spark, sf)
    return d.select("conv_id", "turn", F.array_join("ids2", ",").alias("ids"), "guided_len", "delta", "orig_len")


# teacher output over the guided ids: one value per position after the first, and
# on turns divisible by 5 one value short (invalid)
_TEACHER_SQL = _SPLICE_SQL + """,
te AS (SELECT *, list_transform(CASE WHEN turn % 5 = 0 THEN ids2[2:len(ids2) - 1] ELSE ids2[2:] END,
                                lambda x: -x / 10.0e0) AS lps FROM gs)"""


def _teacher(spark, sf):
    d = _splice(spark, sf)
    body = F.when(F.col("turn") % 5 == 0, F.slice("ids2", 2, F.greatest(F.size("ids2") - 2, F.lit(0)))).otherwise(
        F.slice("ids2", 2, F.greatest(F.size("ids2") - 1, F.lit(0))))
    return d.withColumn("lps", F.transform(body, lambda x: -x / F.lit(10.0)))


@query("validate_lengths", _TEACHER_SQL + """
SELECT conv_id, turn,
  (guided_len - delta >= 0 AND orig_len >= guided_len - delta
   AND greatest(len(lps) - greatest(guided_len - 1, 0), 0) = orig_len - (guided_len - delta)) AS guided_valid,
  len(lps) = greatest(orig_len - 1, 0) AS plain_valid FROM te""")
def q_validate_lengths(spark, sf):
    d = _teacher(spark, sf)
    return d.select("conv_id", "turn",
                    ds.validate_guided(F.col("lps"), F.col("guided_len"), F.col("delta"), F.col("orig_len")).alias(
                        "guided_valid"),
                    ds.validate_plain(F.col("lps"), F.col("orig_len")).alias("plain_valid"))


@query("recover_alignment", _TEACHER_SQL + """,
rc AS (SELECT *, greatest(orig_len - 1, 0) AS target,
         list_concat(list_transform(range(greatest(guided_len - delta - 1, 0)), lambda i: 0.0e0),
                     lps[greatest(guided_len - 1, 0) + 1:]) AS kept FROM te),
rr AS (SELECT *, CASE WHEN target <= 0 THEN []::DOUBLE[] WHEN len(kept) >= target THEN kept[1:target]
                      ELSE list_concat(kept, list_transform(range(target - len(kept)), lambda i: 0.0e0)) END AS rec FROM rc)
SELECT conv_id, turn, CAST(len(rec) AS INT) AS n, round(coalesce(list_sum(rec), 0.0e0), 6) + 0.0e0 AS total,
  CAST(len(list_filter(rec, lambda v: v = 0.0e0)) AS INT) AS n_zero FROM rr""")
def q_recover_alignment(spark, sf):
    d = _teacher(spark, sf)
    rec = ds.recover_alignment(F.col("lps"), F.col("guided_len"), F.col("delta"), F.col("orig_len"))
    d = d.select("conv_id", "turn", rec.alias("rec"))
    return d.select("conv_id", "turn", F.size("rec").alias("n"),
                    rnd(F.aggregate("rec", F.lit(0.0), lambda a, v: a + v)).alias("total"),
                    F.size(F.filter("rec", lambda v: v == 0.0)).alias("n_zero"))


@query("align_to_mask", """
, a AS (SELECT sample_id, list(teacher_log_prob ORDER BY t) AS tl, count(*) AS n,
          CAST(sum(action_mask) AS BIGINT) AS m FROM fx_tokens GROUP BY sample_id),
b AS (SELECT sample_id, CASE WHEN n + 2 - m <= 0 THEN []::DOUBLE[] WHEN len(tl) >= n + 2 - m THEN tl[1:n + 2 - m]
        ELSE list_concat(tl, list_transform(range(n + 2 - m - len(tl)), lambda i: 0.0e0)) END AS al FROM a)
SELECT sample_id, CAST(len(al) AS INT) AS n, round(coalesce(list_sum(al), 0.0e0), 6) + 0.0e0 AS total FROM b""", T)
def q_align_to_mask(spark, sf):
    t = fx.fx_tokens(spark, sf)
    a = t.groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "teacher_log_prob"))), lambda e: e["teacher_log_prob"]).alias("tl"),
        F.count(F.lit(1)).alias("n"), F.sum("action_mask").alias("m"))
    al = ds.align_to_mask(F.col("tl"), (F.col("n") + 2 - F.col("m")).cast("int"))
    d = a.select("sample_id", al.alias("al"))
    return d.select("sample_id", F.size("al").alias("n"),
                    rnd(F.aggregate("al", F.lit(0.0), lambda x, v: x + v)).alias("total"))


def _enc(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '\\w+'), lambda x: CAST(length(x) AS INT))"


def _ask(ids: str) -> str:
    """The logged teacher: fails on every 11th length, is one value short on every 5th."""
    return (f"CASE WHEN len({ids}) % 11 = 0 THEN NULL WHEN len({ids}) % 5 = 0 THEN list_transform({ids}[2:len({ids}) - 1], lambda x: -x / 10.0e0) "
            f"ELSE list_transform({ids}[2:], lambda x: -x / 10.0e0) END")


def _zeros(n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda i: 0.0e0)"


@query("guided_batch", f"""
, a AS (SELECT conv_id, turn, role, text, {_enc("text")} AS ids, CASE WHEN turn % 3 = 2 THEN 3 ELSE 0 END AS hint,
    text || CASE WHEN turn % 3 = 1 THEN ' eightlet' ELSE ' ninechars ninechars' END AS prompt,
    CASE WHEN turn % 7 = 6 THEN ' ' ELSE ' hint ' || role || ' ' END AS guide FROM conversations),
b AS (SELECT *, list_concat(list_concat(ids, [9, 9]), list_reverse(ids)) AS q, {_enc("prompt")} AS pi, {_enc("guide")} AS gi FROM a),
c AS (SELECT *, CASE WHEN hint > 0 AND hint < len(q) THEN hint
    ELSE nullif(coalesce(list_position(list_transform(range(1, least(len(q), len(pi)) + 1), lambda i: q[i] = pi[i]), false) - 1, least(len(q), len(pi))), 0) END AS p FROM b),
d AS (SELECT *, CASE WHEN role = 'assistant' OR trim(guide) = '' OR p IS NULL THEN NULL
    WHEN p >= 2 AND q[p - 1:p] = [9, 9] THEN list_concat(list_concat(q[1:p - 2], gi), [9, 9])
    WHEN ends_with(prompt, ' ninechars ninechars') THEN {_enc("text || guide || ' ninechars ninechars'")} END AS gp FROM c),
e AS (SELECT *, CASE WHEN len(gp) - p > 0 THEN list_concat(gp, q[p + 1:]) END AS input FROM d),
f AS (SELECT *, len(q) AS n, CASE WHEN input IS NOT NULL THEN {_ask("input")} END AS lps, {_ask("q")} AS plain FROM e),
g AS (SELECT *, coalesce(lps IS NOT NULL AND n >= p AND greatest(len(lps) - (len(gp) - 1), 0) = n - p, false) AS good,
    coalesce(len(plain) = greatest(n - 1, 0), false) AS plain_good FROM f),
h AS (SELECT *, CASE WHEN good THEN list_concat(list_concat({_zeros("p - 1")}, lps[len(gp):]), {_zeros("n - 1 - (p - 1) - (len(lps) - len(gp) + 1)")})[1:n - 1]
    WHEN plain_good THEN plain END AS v0 FROM g),
i AS (SELECT *, CASE WHEN len(v0) > 0 THEN v0 ELSE [0.0e0] END AS v, n - 2 + turn % 4 AS m FROM h)
SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN m <= 0 THEN [] ELSE list_concat(v, {_zeros("m - len(v)")})[1:m] END,
    lambda x: CAST(round(x * 10) AS INT)), ',') AS teacher, CASE WHEN good THEN 1.0e0 ELSE 0.0e0 END AS guide_applied,
  CASE WHEN input IS NOT NULL AND NOT good THEN 1.0e0 ELSE 0.0e0 END AS guide_fallback,
  CASE WHEN v0 IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END AS kd_valid FROM i""")
def q_guided_batch(spark, sf):
    """D6 over all turns: assistants are not guided, every seventh guide is blank, the
    prompt ends with the suffix, with something else, or at a hint (encoded again)."""
    def encode(text):
        return F.transform(F.regexp_extract_all(text, F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))

    def teacher(ids):
        n = F.size(ids)
        full = F.transform(F.slice(ids, 2, F.greatest(n - F.when(n % 5 == 0, 2).otherwise(1), F.lit(0))), lambda x: -x / F.lit(10.0))
        return F.when(n % 11 != 0, full)

    c = table(spark, sf, "conversations").withColumn("ids", encode(F.col("text")))
    d = c.select("conv_id", "turn", "role", F.concat("ids", F.array(F.lit(9), F.lit(9)), F.reverse("ids")).alias("query_ids"),
                 F.concat("text", F.when(F.col("turn") % 3 == 1, " eightlet").otherwise(" ninechars ninechars")).alias("prompt"),
                 F.when(F.col("turn") % 7 == 6, "").otherwise(F.concat(F.lit("hint "), F.col("role"), F.lit(" "))).alias("label"),
                 F.when(F.col("turn") % 3 == 2, 3).otherwise(0).alias("hint"))
    d = d.withColumn("mask_len", (F.size("query_ids") - 2 + F.col("turn") % 4).cast("int"))
    out = ds.guided_batch(d, teacher, encode, " ninechars ninechars", guide_prefix=" ", enabled=F.col("role") != "assistant",
                          hint_col="hint", mask_len_col="mask_len")
    tenths = F.transform("teacher_log_probs", lambda x: F.round(x * 10).cast("int"))
    return out.select("conv_id", "turn", F.array_join(tenths, ",").alias("teacher"), "guide_applied", "guide_fallback", "kd_valid")


@query("finite_check", """
SELECT sample_id, t, isfinite(ln(-log_prob)) AND isfinite(teacher_log_prob) AS finite FROM fx_tokens""", T)
def q_finite_check(spark, sf):
    t = fx.fx_tokens(spark, sf)
    # ln(0) is -inf in both engines: zero-quantity rows become non-finite
    x = F.when(-F.col("log_prob") > 0, F.log(-F.col("log_prob"))).otherwise(F.lit(float("-inf")))
    return t.select("sample_id", "t", (ds.is_finite(x) & ds.is_finite(F.col("teacher_log_prob"))).alias("finite"))


@query("teacher_coverage", """
SELECT t.sample_id, round(least(CAST(s.n - 1 AS DOUBLE), greatest(CAST(t.m AS DOUBLE), 1.0e0)) / greatest(CAST(t.m AS DOUBLE), 1.0e0), 6) AS teacher_cov_ratio,
  CAST(s.n - 1 AS DOUBLE) AS teacher_len, 1.0e0 AS teacher_finite_ratio
FROM (SELECT sample_id, sum(action_mask) AS m FROM fx_tokens GROUP BY sample_id) t
JOIN (SELECT sample_id, count(*) AS n FROM fx_tokens GROUP BY sample_id) s USING (sample_id)""", T)
def q_teacher_coverage(spark, sf):
    t = fx.fx_tokens(spark, sf)
    tl = t.groupBy("sample_id").agg((F.count(F.lit(1)) - 1).alias("teacher_len"))
    d = ds.teacher_coverage(t, tl)
    return d.select("sample_id", rnd("teacher_cov_ratio").alias("teacher_cov_ratio"), "teacher_len",
                    "teacher_finite_ratio")


@query("kd_diagnostics", """
, a AS (SELECT sample_id, action_mask AS m, teacher_log_prob AS tl, log_prob AS sl,
          (teacher_log_prob - log_prob) * action_mask AS adv FROM fx_tokens),
s AS (SELECT sample_id, sum(m) AS sm, sum(tl * m) AS st, sum(sl * m) AS ss, sum(abs(adv) * m) AS sa,
        sum(adv * m) / greatest(sum(m), 1) AS mean FROM a GROUP BY sample_id),
v AS (SELECT a.sample_id, sum(power(adv - mean, 2) * m) / greatest(sum(m), 1) AS var FROM a JOIN s USING (sample_id) GROUP BY a.sample_id)
SELECT sample_id, round(st / nullif(sm, 0), 6) AS kd_teacher_logp_mean, round(ss / nullif(sm, 0), 6) AS kd_student_logp_mean,
  round(sa / nullif(sm, 0), 6) AS kd_adv_abs_mean, round(sqrt(var + 1e-8), 6) AS kd_adv_std,
  round(sm / greatest(sm, 1), 6) AS kd_finite_ratio, sm / greatest(sm, 1) < 1.0 AS non_finite_warning
FROM s JOIN v USING (sample_id)""", T)
def q_kd_diagnostics(spark, sf):
    d = ds.kd_diagnostics(fx.fx_tokens(spark, sf))
    return d.select("sample_id", *[rnd(c).alias(c) for c in (
        "kd_teacher_logp_mean", "kd_student_logp_mean", "kd_adv_abs_mean", "kd_adv_std", "kd_finite_ratio")],
        "non_finite_warning")


@query("kd_coverage_warning", """
, s AS (SELECT sample_id, count(*) AS n, sum(action_mask) AS m FROM fx_tokens GROUP BY sample_id)
SELECT sample_id, round(least(CAST(n - 1 - sample_id % 2 AS DOUBLE), greatest(CAST(m AS DOUBLE), 1.0e0)) / greatest(CAST(m AS DOUBLE), 1.0e0), 6) AS teacher_cov_ratio,
  least(CAST(n - 1 - sample_id % 2 AS DOUBLE), greatest(CAST(m AS DOUBLE), 1.0e0)) / greatest(CAST(m AS DOUBLE), 1.0e0) < 0.9e0 AS low_coverage_warning FROM s""", T)
def q_kd_coverage_warning(spark, sf):
    """A15 with A14: samples whose teacher covers less than nine tenths are marked."""
    t = fx.fx_tokens(spark, sf)
    cover = ds.teacher_coverage(t, t.groupBy("sample_id").agg((F.count(F.lit(1)) - 1 - F.col("sample_id") % 2).alias("teacher_len")))
    d = ds.kd_diagnostics(t, coverage=cover).join(cover.select("sample_id", "teacher_cov_ratio"), "sample_id")
    return d.select("sample_id", rnd("teacher_cov_ratio").alias("teacher_cov_ratio"), "low_coverage_warning")


@query("hybrid_diagnostics", """
, per AS (SELECT sample_id, sum(teacher_log_prob * action_mask) / nullif(sum(action_mask), 0) AS tm,
            sum(log_prob * action_mask) / nullif(sum(action_mask), 0) AS sm,
            sum((teacher_log_prob - log_prob) * action_mask) / greatest(sum(action_mask), 1) AS am
          FROM fx_tokens GROUP BY sample_id)
SELECT count(*) AS kd_samples, CAST(sum(CASE WHEN s.skip THEN 1 ELSE 0 END) AS BIGINT) AS kd_skip_samples,
  round(avg(tm), 6) AS teacher_logp_mean, round(avg(sm), 6) AS student_logp_mean, round(avg(am), 6) AS adv_mean
FROM per JOIN fx_token_samples s USING (sample_id) WHERE s.reward > 0.5e0""", TS)
def q_hybrid_diagnostics(spark, sf):
    s = fx.fx_token_samples(spark, sf).withColumn("kd_mask", F.col("reward"))
    d = ds.hybrid_diagnostics(fx.fx_tokens(spark, sf), s)
    return d.select("kd_samples", "kd_skip_samples", rnd("teacher_logp_mean").alias("teacher_logp_mean"),
                    rnd("student_logp_mean").alias("student_logp_mean"), rnd("adv_mean").alias("adv_mean"))
