"""Offline objectives and diagnostics over logged log-probabilities
(M8-M19, M25-M27, A7-A9, J9).

Token-level reductions are one global aggregate (partial sums per partition);
sequence-level reductions aggregate per sample first, then average. Per-sample
windows (GSPO's sequence ratio) are bounded by the sequence length.

Note on empty masks: the reference divides by the mask sum and so produces NaN
for a sample whose action mask is all zero; here such a sample's masked mean
is NULL and is left out of a sequence-level average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttrain.operators.advantage import clamp


def log_sigmoid(x: Column) -> Column:
    """Stable log(sigmoid(x)) = -(log1p(exp(-|x|)) + max(-x, 0))."""
    return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _mmean(x: Column, m: Column) -> Column:
    return F.sum(x * m) / F.nullif(F.sum(m), F.lit(0.0))


def _reduce(df: DataFrame, loss: Column, mask: Column, token_level: bool, sample_col: str,
            extra: dict[str, Column] | None = None) -> DataFrame:
    """Token-level = global masked mean; sequence-level = mean over
    samples of each sample's masked mean. ``extra`` are further global masked
    means computed in the same pass."""
    extra = extra or {}
    m = mask.cast("double")
    if token_level:
        return df.agg(_mmean(loss, m).alias("loss"), *[_mmean(v, m).alias(k) for k, v in extra.items()])
    per = df.groupBy(sample_col).agg(
        _mmean(loss, m).alias("__l"),
        *[F.sum(v * m).alias(f"__s_{k}") for k in extra for v in [extra[k]]],
        F.sum(m).alias("__m"))
    return per.agg(F.avg("__l").alias("loss"),
                   *[(F.sum(f"__s_{k}") / F.nullif(F.sum("__m"), F.lit(0.0))).alias(k) for k in extra])


def policy_loss(tokens: DataFrame, loss_type: str = "ppo", clip_low: float = 0.2, clip_high: float = 0.2,
                dual_clip: float | None = None, token_level: bool = True, is_correction: str | None = None,
                is_threshold: tuple[float, float] = (0.5, 5.0), lp: str = "log_prob", old: str = "old_log_prob",
                adv: str = "advantages", mask: str = "action_mask", rollout: str = "rollout_log_prob",
                sample_col: str = "sample_id") -> DataFrame:
    """PPO / GSPO policy loss with optional dual clip and truncated
    importance sampling (``'tis'`` clamps exp(old - rollout) to the thresholds,
    ``'icepop'`` zeroes it outside them; PPO only). One output row:
    loss, clip_ratio, ppo_kl (, rollout_kl)."""
    m = F.col(mask).cast("double")
    if loss_type == "ppo":
        log_ratio = F.col(lp) - F.col(old)
        ratio = F.exp(log_ratio)
    elif loss_type == "gspo":
        token_level = False  # GSPO forces sequence-level reduction
        log_ratio = F.col(lp) - (F.col(rollout) if is_correction else F.col(old))
        w = Window.partitionBy(sample_col)
        seq = F.sum(log_ratio * m).over(w) / F.nullif(F.sum(m).over(w), F.lit(0.0))
        ratio = F.exp(seq) * m
    else:
        raise ValueError(f"invalid policy loss type {loss_type!r}")
    a = F.col(adv)
    d = tokens.withColumn("__ratio", ratio).withColumn("__lr", log_ratio)
    r = F.col("__ratio")
    surr1 = r * a
    surr2 = clamp(r, 1.0 - clip_low, 1.0 + clip_high) * a
    clip1 = F.least(surr1, surr2)
    if dual_clip is None:
        loss = -clip1
    else:
        if dual_clip <= 1.0:
            raise ValueError("dual_clip must be > 1.0")
        loss = -F.when(a < 0, F.greatest(clip1, F.lit(float(dual_clip)) * a)).otherwise(clip1)
    extra = {"clip_ratio": F.when(surr2 < surr1, 1.0).otherwise(0.0), "ppo_kl": -F.col("__lr")}
    if is_correction and loss_type == "ppo":
        lo, hi = is_threshold
        w_is = F.exp(F.col(old) - F.col(rollout))
        if is_correction == "icepop":
            w_is = F.when((w_is >= lo) & (w_is <= hi), w_is).otherwise(F.lit(0.0))
        else:
            w_is = clamp(w_is, lo, hi)
        loss = w_is * loss
        extra["rollout_kl"] = F.col(rollout) - F.col(old)
    d = d.withColumn("__loss", loss)
    if token_level:
        return _reduce(d, F.col("__loss"), m, True, sample_col, extra)
    # sequence-level loss; the diagnostics stay global token means, in the same pass
    return _reduce(d, F.col("__loss"), m, False, sample_col, extra)


def value_loss(tokens: DataFrame, values: str, old_values: str, returns: str, mask: str = "action_mask",
               clip_eps: float | None = None, token_level: bool = True, sample_col: str = "sample_id") -> DataFrame:
    """0.5 * masked mean of the (clipped) squared error."""
    v, ov, rt = F.col(values), F.col(old_values), F.col(returns)
    if clip_eps is not None:
        vc = ov + F.least(F.greatest(v - ov, F.lit(-clip_eps)), F.lit(clip_eps))
        loss = F.greatest(F.pow(vc - rt, 2), F.pow(v - rt, 2))
    else:
        loss = F.pow(v - rt, 2)
    d = _reduce(tokens, loss, F.col(mask), token_level, sample_col)
    return d.select((F.lit(0.5) * F.col("loss")).alias("loss"))


def sft_loss(tokens: DataFrame, lp: str = "log_prob", mask: str = "action_mask", token_level: bool = True,
             sample_col: str = "sample_id") -> DataFrame:
    """Masked mean of -log p, token or sequence level."""
    return _reduce(tokens, -F.col(lp), F.col(mask), token_level, sample_col)


def pairwise_loss(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                  margin: str | None = None) -> DataFrame:
    """Mean of -logsigmoid(chosen - rejected - margin)."""
    x = F.col(chosen) - F.col(rejected) - (F.col(margin) if margin else F.lit(0.0))
    return pairs.agg(F.avg(-log_sigmoid(x)).alias("loss"))


def logexp_loss(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Mean of log(1 + exp(rejected - chosen))."""
    z = F.col(rejected) - F.col(chosen)
    return pairs.agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))).alias("loss"))


def dpo(pairs: DataFrame, beta: float, label_smoothing: float = 0.0, ipo: bool = False,
        pc: str = "policy_chosen", pr: str = "policy_rejected", rc: str = "reference_chosen",
        rr: str = "reference_rejected") -> tuple[DataFrame, DataFrame]:
    """Per-pair rewards and the mean loss. Returns (rewards per pair, loss row)."""
    logits = (F.col(pc) - F.col(pr)) - (F.col(rc) - F.col(rr))
    if ipo:
        losses = F.pow(logits - F.lit(1.0 / (2 * beta)), 2)
    else:
        losses = (-log_sigmoid(F.lit(beta) * logits) * (1 - label_smoothing)
                  - log_sigmoid(-F.lit(beta) * logits) * label_smoothing)
    rewards = pairs.select("*", (F.lit(beta) * (F.col(pc) - F.col(rc))).alias("chosen_reward"),
                           (F.lit(beta) * (F.col(pr) - F.col(rr))).alias("rejected_reward"))
    return rewards, pairs.agg(F.avg(losses).alias("loss"))


def kto_vanilla(pairs: DataFrame, beta: float, pc: str = "policy_chosen", pr: str = "policy_rejected",
                rc: str = "reference_chosen", rr: str = "reference_rejected") -> DataFrame:
    """Paired KTO; batch KLs (clamped >= 0) from one global aggregate,
    broadcast back; loss = mean over both halves."""
    kl = pairs.agg(F.struct(F.greatest(F.avg(F.col(pc) - F.col(rc)), F.lit(0.0)).alias("c"),
                            F.greatest(F.avg(F.col(pr) - F.col(rr)), F.lit(0.0)).alias("r"))).scalar()
    cl = F.lit(1.0) - sigmoid(F.lit(beta) * ((F.col(pc) - F.col(rc)) - kl["r"]))
    rl = F.lit(1.0) - sigmoid(F.lit(beta) * (kl["c"] - (F.col(pr) - F.col(rr))))
    return pairs.agg(((F.sum(cl) + F.sum(rl)) / (F.count(F.lit(1)) * 2)).alias("loss"))


def kto(chosen: DataFrame, rejected: DataFrame, kl_rows: DataFrame, beta: float, desirable_weight: float,
        undesirable_weight: float, policy: str = "policy", reference: str = "reference",
        rank_col: str | None = "rank") -> DataFrame:
    """Uneven KTO. KL = mean over ranks of each rank's mean
    (policy_KL - reference_KL), clamped >= 0; either side may be empty; the
    loss is the mean over the weighted union of both sides."""
    diff = F.col(policy) - F.col(reference)
    if rank_col:
        kl = kl_rows.groupBy(rank_col).agg(F.avg(diff).alias("__k")).agg(F.avg("__k").alias("__kl"))
    else:
        kl = kl_rows.agg(F.avg(diff).alias("__kl"))
    klv = kl.select(F.greatest(F.col("__kl"), F.lit(0.0))).scalar()
    c = chosen.select(
        (F.lit(desirable_weight) * (F.lit(1.0) - sigmoid(F.lit(beta) * (diff - klv)))).alias("l"))
    r = rejected.select(
        (F.lit(undesirable_weight) * (F.lit(1.0) - sigmoid(F.lit(beta) * (klv - diff)))).alias("l"))
    return c.unionByName(r).agg(F.avg("l").alias("loss")).withColumn("kl", klv)


def zscore_reward(r: Column, mean: float, std: float) -> Column:
    """(r - mean) / std with stored normalisation constants."""
    return (r - F.lit(mean)) / F.lit(std)


def total_loss(policy: Column, kl_loss: Column, entropy: Column, kl_coef: float, ent_coef: float,
               loss_scale: Column | float = 1.0) -> Column:
    """(policy + kl_coef*kl_loss - ent_coef*entropy) * loss_scale."""
    ls = F.lit(loss_scale) if isinstance(loss_scale, float) else loss_scale
    return (policy + F.lit(kl_coef) * kl_loss - F.lit(ent_coef) * entropy) * ls


def metric_mean(status: DataFrame, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Plain mean of every metric over mini-batches (keys = union)."""
    return status.groupBy(metric_col).agg(F.avg(value_col).alias("mean"))


def all_reduce(values: DataFrame, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Mean / max / sum of each metric across ranks (partial + final agg)."""
    return values.groupBy(metric_col).agg(F.avg(value_col).alias("mean"), F.max(value_col).alias("max"),
                                          F.sum(value_col).alias("sum"))


def pair_join(rows: DataFrame, prompt_col: str, score_col: str, value_cols: list[str]) -> DataFrame:
    """Chosen (best score) and rejected (worst score) row of each prompt
    as one aligned pair row. Two aggregates on the prompt key (map-side
    combined; a hot prompt costs one partial row per partition), joined 1:1."""
    best = rows.groupBy(prompt_col).agg(
        *[F.max_by(F.col(c), F.col(score_col)).alias(f"chosen_{c}") for c in value_cols],
        F.count(F.lit(1)).alias("__n"))
    worst = rows.groupBy(prompt_col).agg(
        *[F.min_by(F.col(c), F.col(score_col)).alias(f"rejected_{c}") for c in value_cols])
    return best.filter(F.col("__n") > 1).drop("__n").join(worst, prompt_col)
