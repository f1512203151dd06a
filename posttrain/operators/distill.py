"""Guided distillation over token-id arrays and teacher diagnostics
(D1-D6, J6, A14-A16, P24).

Everything is an array expression on one row (a sample), so the work is
embarrassingly parallel; only the diagnostics aggregate, per sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttrain.functions.text import guide_text, pystrip


def zero_vec() -> Column:
    """The one-element zero vector used for rows without a teacher result."""
    return F.array(F.lit(0.0))


def is_finite(x: Column) -> Column:
    """Not NaN and not +/-inf."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def common_prefix_len(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays. ``zip_with`` reads
    each input once (a lambda that indexes the arrays would re-evaluate them
    per element)."""
    n = F.least(F.size(a), F.size(b))
    pos = F.array_position(F.zip_with(a, b, lambda x, y: x == y), False)
    return F.when(pos == 0, n).otherwise((pos - 1).cast("int"))


def prompt_boundary(query_ids: Column, prompt_ids: Column, hint: Column | None = None) -> Column:
    """Prompt length inside ``query_ids``: the hint when 0 < hint < len;
    else the prompt's length when it is an exact prefix; else the longest
    common prefix (which equals the prompt length for an exact prefix, so one
    expression covers both). Null (failure) when <= 0 or the prompt is empty."""
    plen = common_prefix_len(query_ids, prompt_ids)
    plen = F.when((F.size(prompt_ids) > 0) & (plen > 0), plen)
    if hint is not None:
        plen = F.when((hint > 0) & (hint < F.size(query_ids)), hint.cast("int")).otherwise(plen)
    return plen


def guided_splice(query_ids: Column, p_len: Column, guide_ids: Column, suffix_ids: Column, prompt: Column | None = None,
                  guide: Column | None = None, suffix: Column | None = None, encode: Callable[[Column], Column] | None = None) -> Column:
    """When the prompt ``query_ids[:p_len]`` ends with the chat suffix, insert
    ``guide_ids`` before it. Otherwise, given the texts and ``encode`` (text to ids),
    the guide goes before the suffix of the prompt's text (at its end without a
    suffix) and the text is encoded again. Returns struct(ids, guided_len, delta,
    orig_len); null when neither way is open, the guide is blank or delta <= 0."""
    ns = F.size(suffix_ids)
    ng = F.size(guide_ids)
    empty = F.array().cast("array<int>")
    ends = (ns > 0) & (p_len >= ns) & (F.slice(query_ids, F.greatest(p_len - ns + 1, F.lit(1)),
                                               F.greatest(ns, F.lit(1))) == suffix_ids)
    head = F.when(p_len > ns, F.slice(query_ids, 1, F.greatest(p_len - ns, F.lit(1)))).otherwise(empty)
    resp = F.when(F.size(query_ids) > p_len,
                  F.slice(query_ids, p_len + 1, F.greatest(F.size(query_ids) - p_len, F.lit(1)))).otherwise(empty)
    ok = p_len.isNotNull() & (p_len > 0) & ends & (ng > 0)
    out = F.when(ok, F.struct(F.concat(head, guide_ids, suffix_ids, resp).alias("ids"),
                              (p_len + ng).alias("guided_len"), ng.alias("delta"),
                              F.size(query_ids).alias("orig_len")))
    if encode is None:
        return out
    end = F.coalesce(suffix, F.lit(""))
    again = encode(F.concat(F.substring(prompt, F.lit(1), F.length(prompt) - F.length(end)), guide, end))
    n = F.size(again)
    may = (p_len > 0) & F.endswith(prompt, end) & (pystrip(guide) != "") & (n > p_len)
    return F.coalesce(out, F.when(may, F.struct(
        F.concat(again, resp).alias("ids"), n.alias("guided_len"), (n - p_len).alias("delta"), F.size(query_ids).alias("orig_len"))))


def validate_plain(lps: Column, orig_len: Column) -> Column:
    """D3 plain: teacher output has exactly max(orig_len - 1, 0) values."""
    return F.size(lps) == F.greatest(orig_len - 1, F.lit(0))


def validate_guided(lps: Column, g_len: Column, delta: Column, orig_len: Column) -> Column:
    """D3 guided: the teacher output still covers the whole response."""
    orig_p = g_len - delta
    actual = F.greatest(F.size(lps) - F.greatest(g_len - 1, F.lit(0)), F.lit(0))
    return (orig_p >= 0) & (orig_len >= orig_p) & (actual == orig_len - orig_p)


def pad_or_cut(arr: Column, target: Column, value: float = 0.0) -> Column:
    """First ``target`` values of ``arr``, right-padded with ``value``."""
    cut = F.slice(arr, 1, F.greatest(target, F.lit(1)))
    padded = F.concat(arr, F.array_repeat(F.lit(value), F.greatest(target - F.size(arr), F.lit(0))))
    return F.when(target <= 0, F.array().cast("array<double>")).when(
        F.size(arr) >= target, cut).otherwise(padded)


def recover_alignment(lps: Column, g_len: Column, delta: Column, orig_len: Column) -> Column:
    """Zeros for the original prompt, teacher values for the response,
    cut or zero-padded to orig_len - 1."""
    target = F.greatest(orig_len - 1, F.lit(0))
    orig_p = g_len - delta
    start = F.greatest(g_len - 1, F.lit(0))
    resp = F.when(F.size(lps) > start, F.slice(lps, start + 1, F.greatest(F.size(lps) - start, F.lit(1)))).otherwise(
        F.array().cast("array<double>"))
    kept = F.concat(F.array_repeat(F.lit(0.0), F.greatest(orig_p - 1, F.lit(0))), resp)
    return pad_or_cut(kept, target)


def align_to_mask(teacher: Column, mask_len: Column) -> Column:
    """Teacher values padded with 0.0 / truncated to the action mask length."""
    return pad_or_cut(teacher, mask_len)


def guided_batch(batch: DataFrame, teacher: Callable[[Column], Column], encode: Callable[[Column], Column], chat_suffix: str,
                 guide_prefix: str = "", guide_suffix: str = "", enabled: Column | None = None, query_col: str = "query_ids",
                 prompt_col: str = "prompt", label_col: str = "label", hint_col: str | None = None,
                 mask_len_col: str | None = None) -> DataFrame:
    """Teacher values for a whole batch, one aligned array a row.

    Where ``enabled`` (all rows by default) the prompt's end is found (D1), the guide
    (prefix, label, suffix; T6) is put in before the chat suffix, by ids or by encoding
    the text again (D2), and ``teacher`` (ids to log-probs; null for a failed call) is
    asked about the guided ids; its values count if they cover the response (D3) and
    are put back in the places of the original ids (D4). Other rows, and rows whose
    guided values do not count, take the teacher's values for the original ids if there
    is one for each id after the first (D3). What is left gets the one-element zero
    vector. With ``mask_len_col`` the array is cut or padded to that length (D5).

    Adds ``teacher_log_probs, guide_applied, guide_fallback, kd_valid``. Everything is
    one projection: no row meets another."""
    ids, prompt = F.col(query_col), F.col(prompt_col)
    suffix = F.lit(chat_suffix)
    guide = guide_text(F.col(label_col), guide_prefix, guide_suffix)
    p_len = prompt_boundary(ids, encode(prompt), F.col(hint_col) if hint_col else None)
    d = batch.withColumn("__p", p_len).withColumn("__guide", F.when(F.lit(True) if enabled is None else enabled, guide))
    built = guided_splice(ids, F.col("__p"), encode(F.col("__guide")), encode(suffix), prompt, F.col("__guide"), suffix, encode)
    d = d.withColumn("__in", F.when(F.col("__guide").isNotNull() & F.col("__p").isNotNull(), built))
    g = F.col("__in")
    d = d.withColumn("__lps", F.when(g.isNotNull(), teacher(g["ids"])))
    # a failed call has no values, which is not the same as values for an empty response
    good = F.col("__lps").isNotNull() & F.coalesce(validate_guided(F.col("__lps"), g["guided_len"], g["delta"], g["orig_len"]), F.lit(False))
    d = d.withColumn("__good", good).withColumn("__plain", F.when(~F.col("__good"), teacher(ids)))
    plain_good = F.col("__plain").isNotNull() & F.coalesce(validate_plain(F.col("__plain"), F.size(ids)), F.lit(False))
    value = (F.when(F.col("__good"), recover_alignment(F.col("__lps"), g["guided_len"], g["delta"], g["orig_len"]))
             .when(plain_good, F.col("__plain")))
    valid = value.isNotNull()
    value = F.when(valid & (F.size(value) > 0), value).otherwise(zero_vec())
    if mask_len_col:
        value = align_to_mask(value, F.col(mask_len_col))
    return d.select(*batch.columns, value.alias("teacher_log_probs"), F.col("__good").cast("double").alias("guide_applied"),
                    (g.isNotNull() & ~F.col("__good")).cast("double").alias("guide_fallback"), valid.cast("double").alias("kd_valid"))


def kd_scatter(batch: DataFrame, results: DataFrame, key: str = "sample_id",
               value_col: str = "teacher_log_probs") -> DataFrame:
    """Teacher results for the KD subset back onto the whole batch; rows
    without one get the one-element zero vector and kd_mask 0."""
    r = results.select(key, F.col(value_col).alias("__v"))
    d = batch.join(r, key, "left")
    return d.withColumn(value_col, F.coalesce(F.col("__v"), zero_vec())).withColumn(
        "kd_mask", F.when(F.col("__v").isNull(), 0.0).otherwise(1.0)).drop("__v")


def teacher_coverage(tokens: DataFrame, teacher_len: DataFrame, sample_col: str = "sample_id",
                     mask_col: str = "action_mask", teacher_col: str = "teacher_log_prob") -> DataFrame:
    """Per sample cov_ratio = min(teacher_len, valid)/valid with valid =
    max(sum(mask), 1), the teacher length, and the finite ratio of the padded
    teacher values over all positions."""
    per = tokens.groupBy(sample_col).agg(
        F.greatest(F.sum(F.col(mask_col)).cast("double"), F.lit(1.0)).alias("__valid"),
        F.avg(F.when(is_finite(F.col(teacher_col)), 1.0).otherwise(0.0)).alias("teacher_finite_ratio"))
    d = per.join(teacher_len, sample_col)
    return d.select(sample_col,
                    (F.least(F.col("teacher_len").cast("double"), F.col("__valid")) / F.col("__valid")).alias(
                        "teacher_cov_ratio"),
                    F.col("teacher_len").cast("double").alias("teacher_len"), "teacher_finite_ratio")


def kd_diagnostics(tokens: DataFrame, sample_col: str = "sample_id", mask_col: str = "action_mask",
                   teacher_col: str = "teacher_log_prob", student_col: str = "log_prob",
                   coverage: DataFrame | None = None) -> DataFrame:
    """Per sample teacher/student masked means, |adv| mean, adv std
    sqrt(var + 1e-8) over masked tokens (count clamped >= 1), finite ratio and,
    given A14's ``coverage``, ``low_coverage_warning`` (teacher_cov_ratio < 0.9;
    false where it is not known). adv = (teacher - student) * mask."""
    m = F.col(mask_col).cast("double")
    a = (F.col(teacher_col) - F.col(student_col)) * m
    fin = F.when(is_finite(F.col(teacher_col)) & is_finite(F.col(student_col)), 1.0).otherwise(0.0)
    chosen = F.when(F.col(mask_col) == 1, F.col(teacher_col) - F.col(student_col))
    per = tokens.groupBy(sample_col).agg(
        F.sum(m).alias("__sm"), F.sum(F.col(teacher_col) * m).alias("__st"),
        F.sum(F.col(student_col) * m).alias("__ss"), F.sum(F.abs(a) * m).alias("__sa"),
        F.var_pop(chosen).alias("__var"), F.sum(fin * m).alias("__sf"))
    cnt = F.greatest(F.col("__sm"), F.lit(1.0))
    var = F.coalesce(F.col("__var"), F.lit(0.0))  # the variance that Spark merges without cancelling
    out = per.select(
        sample_col,
        (F.col("__st") / F.nullif(F.col("__sm"), F.lit(0.0))).alias("kd_teacher_logp_mean"),
        (F.col("__ss") / F.nullif(F.col("__sm"), F.lit(0.0))).alias("kd_student_logp_mean"),
        (F.col("__sa") / F.nullif(F.col("__sm"), F.lit(0.0))).alias("kd_adv_abs_mean"),
        F.sqrt(var + F.lit(1e-8)).alias("kd_adv_std"),
        (F.col("__sf") / cnt).alias("kd_finite_ratio"),
        ((F.col("__sf") / cnt) < 1.0).alias("non_finite_warning"))
    if coverage is None:
        return out
    low = coverage.select(sample_col, (F.col("teacher_cov_ratio") < 0.9).alias("low_coverage_warning"))
    return out.join(low, sample_col, "left").fillna(False, ["low_coverage_warning"])


def hybrid_diagnostics(tokens: DataFrame, samples: DataFrame, sample_col: str = "sample_id",
                       mask_col: str = "action_mask", teacher_col: str = "teacher_log_prob",
                       student_col: str = "log_prob") -> DataFrame:
    """Per KD sample teacher/student/adv means, then global counts of KD
    samples and of pure-KD (skip) samples. ``samples`` has kd_mask and skip."""
    m = F.col(mask_col).cast("double")
    per = tokens.groupBy(sample_col).agg(
        (F.sum(F.col(teacher_col) * m) / F.nullif(F.sum(m), F.lit(0.0))).alias("teacher_mean"),
        (F.sum(F.col(student_col) * m) / F.nullif(F.sum(m), F.lit(0.0))).alias("student_mean"),
        (F.sum((F.col(teacher_col) - F.col(student_col)) * m * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("adv_mean"))
    d = per.join(samples.filter(F.col("kd_mask") > 0.5).select(sample_col, "skip"), sample_col)
    return d.agg(F.count(F.lit(1)).alias("kd_samples"),
                 F.sum(F.when(F.col("skip"), 1).otherwise(0)).cast("long").alias("kd_skip_samples"),
                 F.avg("teacher_mean").alias("teacher_logp_mean"),
                 F.avg("student_mean").alias("student_logp_mean"),
                 F.avg("adv_mean").alias("adv_mean"))
