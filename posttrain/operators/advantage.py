"""Experience shaping: group baselines, token rewards, returns, whitening
(W1-W12, M1-M7, A10, A11).

Two tables carry an experience batch:

* ``samples`` - one row per sample (``sample_id``, ``group_id``, ``reward``, ...)
* ``tokens``  - one row per response position (``sample_id``, ``t``,
  ``action_mask``, log-prob columns)

Group windows are partitioned by ``group_id`` (bounded by samples per prompt),
token windows by ``sample_id`` (bounded by the sequence length). Whitening is a
single global aggregate used as a scalar subquery, never an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: epsilons of the group std and whitening variance, the
# estimators that use group baselines, and those whose advantages are whitened
EPS_GROUP_STD = 1e-9
EPS_WHITEN_VAR = 1e-8
GROUP_ESTIMATORS = ("rloo", "reinforce_baseline", "group_norm", "dr_grpo")
WHITENED_ESTIMATORS = ("reinforce", "reinforce_baseline")
# fixed value: estimators that refuse a group of one sample
PAIRED_ESTIMATORS = ("rloo", "reinforce_baseline", "group_norm")


# ----------------------------------------------------------------- columns

def clamp(v: Column, lo: float, hi: float) -> Column:
    """``v`` within [lo, hi]; null stays null and NaN stays NaN (``least`` and
    ``greatest`` would skip the one and take the other for the largest number)."""
    return F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def approx_kl(log_probs: Column, base_log_probs: Column, estimator: str = "k1") -> Column:
    """M1: k1 = d, k2 = d^2/2, k3 = exp(-d) - 1 + d with d = logp - base;
    clamped to [-10, 10] last (NaN stays NaN)."""
    d = log_probs - base_log_probs
    if estimator == "k1":
        v = d
    elif estimator == "k2":
        v = d * d / F.lit(2.0)
    elif estimator == "k3":
        v = F.exp(-d) - F.lit(1.0) + d
    else:
        raise ValueError(f"unknown kl estimator {estimator!r}")
    return clamp(v.cast("double"), -10.0, 10.0)


def clip_reward(r: Column, lo: float = -10.0, hi: float = 10.0) -> Column:
    """M2: clamp a reward to [lo, hi] (NaN stays NaN)."""
    return clamp(r.cast("double"), lo, hi)


def overlong_penalty(reward: Column, response_length: Column, max_len: int,
                     buffer_len: int, factor: float = 1.0) -> Column:
    """M4: e = min(len - (max_len - buffer), buffer); reward - e/buffer*factor if e > 0."""
    exceed = F.least(response_length - F.lit(max_len - buffer_len), F.lit(buffer_len))
    return F.when(exceed > 0, reward - exceed / F.lit(float(buffer_len)) * F.lit(float(factor))
                  ).otherwise(reward)


# ------------------------------------------------------------- group level

def group_shaping(samples: DataFrame, estimator: str, group_col: str = "group_id",
                  reward_col: str = "reward", out: str = "shaped_reward") -> DataFrame:
    """W1-W3 (+W4): reward shaping inside each prompt group. All windows share
    one exchange on ``group_col``."""
    w = Window.partitionBy(group_col)
    r = F.col(reward_col)
    n = F.count(F.lit(1)).over(w)
    mean = F.avg(r).over(w)
    if estimator == "rloo":
        shaped = r - (F.sum(r).over(w) - r) / F.nullif((n - 1).cast("double"), F.lit(0.0))
    elif estimator in ("reinforce_baseline", "dr_grpo"):
        shaped = r - mean
    elif estimator == "group_norm":
        shaped = (r - mean) / (F.stddev_samp(r).over(w) + F.lit(EPS_GROUP_STD))
    elif estimator in ("reinforce", "kd"):
        shaped = r
    else:
        raise ValueError(f"unknown advantage estimator {estimator!r}")
    return samples.withColumn(out, shaped)


def group_reward_std(samples: DataFrame, group_col: str = "group_id",
                     reward_col: str = "reward") -> DataFrame:
    """Per-group sample std of the reward, logged on every member; only
    defined for groups of more than one sample."""
    w = Window.partitionBy(group_col)
    return samples.withColumn(
        "group_reward_std",
        F.when(F.count(F.lit(1)).over(w) > 1, F.stddev_samp(reward_col).over(w)))


# ------------------------------------------------------------- token level

def last_valid_token(tokens: DataFrame, sample_col: str = "sample_id", t_col: str = "t",
                     mask_col: str = "action_mask", out: str = "last_t") -> DataFrame:
    """Last position with mask 1; an all-zero mask gives the last position."""
    w = Window.partitionBy(sample_col)
    last = F.coalesce(F.max(F.when(F.col(mask_col) == 1, F.col(t_col))).over(w),
                      F.max(t_col).over(w))
    return tokens.withColumn(out, last)


def token_reward(tokens: DataFrame, samples: DataFrame, kl_coef: float,
                 kl_col: str = "kl", reward_col: str = "reward",
                 sample_col: str = "sample_id", clip: tuple[float, float] | None = None,
                 out: str = "token_reward", carry: tuple[str, ...] = ()) -> DataFrame:
    """M3: scalar reward placed on the last valid token, plus ``-max(kl_coef,0)*kl``
    at every position. ``samples`` is one row per sample, joined on the id; its
    ``carry`` columns come along."""
    coef = max(float(kl_coef), 0.0)
    r = F.col(reward_col)
    if clip:
        r = clip_reward(r, *clip)
    s = samples.select(sample_col, r.alias("__r"), *carry)
    d = last_valid_token(tokens, sample_col).join(s, sample_col, "left")
    val = F.when(F.col("t") == F.col("last_t"), F.coalesce(F.col("__r"), F.lit(0.0))).otherwise(F.lit(0.0))
    return d.withColumn(out, val - F.lit(coef) * F.col(kl_col)).drop("__r")


def discounted_returns(tokens: DataFrame, gamma: float = 1.0, reward_col: str = "token_reward",
                       mask_col: str = "action_mask", sample_col: str = "sample_id",
                       t_col: str = "t", out: str = "returns") -> DataFrame:
    """R_t = m_t r_t + gamma R_{t+1}, a reverse scan per sample; positions that are
    missing count as 0.

    gamma == 1 is a suffix-sum window. Otherwise it is an affine scan over blocks
    of B = floor(600 / |ln gamma|) positions: inside a block the discounted suffix sum
    is a window sum of gamma^(s - block start) * x_s rescaled by gamma^-(t - block
    start), which neither overflows nor underflows; a block as a whole is the map
    R -> sum + gamma^B * R. The maps of a sample's later blocks, one small row each,
    are composed from the last one on, over any number of blocks. All windows share
    the shuffle by sample; tokens are read once and never joined."""
    x = F.col(mask_col).cast("double") * F.col(reward_col)
    if gamma == 1.0:
        w = Window.partitionBy(sample_col).orderBy(F.col(t_col).desc()).rowsBetween(
            Window.unboundedPreceding, 0)
        return tokens.withColumn(out, F.sum(x).over(w))
    if not 0.0 < gamma < 1.0:
        raise ValueError("gamma must be in (0, 1]")
    import math
    B = max(1, int(600.0 / abs(math.log(gamma))))
    step = float(gamma) ** B
    g = F.lit(float(gamma))
    d = tokens.withColumn("__blk", F.floor(F.col(t_col) / B).cast("long"))
    rel = F.col(t_col) - F.col("__blk") * B
    d = d.withColumn("__x", F.pow(g, rel) * x)
    block = Window.partitionBy(sample_col, "__blk")
    after = block.orderBy(F.col(t_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__loc", F.sum("__x").over(after) / F.pow(g, rel)).withColumn("__sum", F.sum("__x").over(block))
    d = d.withColumn("__maps", F.collect_set(F.struct(F.col("__blk").alias("b"), F.col("__sum").alias("s"))).over(Window.partitionBy(sample_col)))
    later = F.reverse(F.array_sort(F.filter("__maps", lambda m: m["b"] > F.col("__blk"))))
    start = F.struct(F.lit(0.0).alias("r"), F.lit(None).cast("long").alias("b"))

    def compose(acc: Column, m: Column) -> Column:
        gap = F.coalesce(acc["b"] - m["b"], F.lit(1)) - 1  # blocks without positions
        return F.struct((m["s"] + acc["r"] * F.lit(step) * F.pow(F.lit(step), gap)).alias("r"), m["b"].alias("b"))

    top = F.aggregate(later, start, compose)
    carry = top["r"] * F.pow(F.lit(step), F.coalesce(top["b"] - F.col("__blk"), F.lit(1)) - 1)
    ret = F.col("__loc") + carry * F.pow(g, F.lit(B) - rel)
    return d.withColumn(out, ret).drop("__blk", "__x", "__loc", "__sum", "__maps")


def masked_moments(tokens: DataFrame, value_col: str, mask_col: str = "action_mask") -> DataFrame:
    """One-row masked mean and population variance in a single pass, using
    Spark's numerically stable (parallel Welford) ``avg`` / ``var_pop`` over
    the masked-in values (a 0/1 mask selects rows; nulls are skipped)."""
    v = F.when(F.col(mask_col) == 1, F.col(value_col))
    return tokens.agg(F.avg(v).alias("__mean"), F.var_pop(v).alias("__var"))


def whiten(tokens: DataFrame, value_col: str = "advantages", mask_col: str = "action_mask",
           use_std: bool = True, out: str | None = None) -> DataFrame:
    """(x - masked mean) * rsqrt(max(masked population var, 1e-8)) over
    all tokens of the batch; applied to every position (unmasked).

    The statistics are one global aggregate (partial per partition, stable
    variance) used as a scalar subquery (evaluated once); the upstream shuffle is
    shared by the aggregate and the apply step (exchange reuse)."""
    out = out or value_col
    st = masked_moments(tokens, value_col, mask_col).select(F.struct("__mean", "__var")).scalar()
    if use_std:
        scale = F.lit(1.0) / F.sqrt(F.greatest(st["__var"], F.lit(EPS_WHITEN_VAR)))
        return tokens.withColumn(out, (F.col(value_col) - st["__mean"]) * scale)
    return tokens.withColumn(out, F.col(value_col) - st["__mean"])


def masked_mean(df: DataFrame, value_col: str, mask_col: str, by: list[str] | None = None,
                out: str = "masked_mean") -> DataFrame:
    """A10: sum(x*m)/sum(m), per group ``by`` or global."""
    m = F.col(mask_col).cast("double")
    e = (F.sum(F.col(value_col) * m) / F.nullif(F.sum(m), F.lit(0.0))).alias(out)
    return df.groupBy(*by).agg(e) if by else df.agg(e)


def masked_normalize(tokens: DataFrame, value_col: str, mask_col: str = "action_mask",
                     sample_col: str = "sample_id", eps: float = 1e-8,
                     out: str = "normalized") -> DataFrame:
    """Per sample: x*m, centred by the masked mean, scaled by
    rsqrt(max(masked var, eps)); masked positions keep the centred value."""
    w = Window.partitionBy(sample_col)
    m = F.col(mask_col).cast("double")
    xm = F.col(value_col) * m
    mean = F.sum(xm * m).over(w) / F.nullif(F.sum(m).over(w), F.lit(0.0))
    d = tokens.withColumn("__c", xm - mean)
    var = F.sum(F.col("__c") * F.col("__c") * m).over(w) / F.nullif(F.sum(m).over(w), F.lit(0.0))
    return d.withColumn(out, F.col("__c") / F.sqrt(F.greatest(var, F.lit(eps)))).drop("__c")


def kd_advantage(tokens: DataFrame, teacher_col: str = "teacher_log_prob",
                 student_col: str = "log_prob", mask_col: str = "action_mask",
                 whiten_std: bool = True, out: str = "advantages") -> DataFrame:
    """M5: (teacher - student) * mask, then W11 whitening."""
    d = tokens.withColumn(out, (F.col(teacher_col) - F.col(student_col)) * F.col(mask_col).cast("double"))
    return whiten(d, out, mask_col, whiten_std)


def hybrid_blend(adv: Column, kd_adv: Column, kd_mask: Column, skip: Column,
                 kd_coef: float) -> Column:
    """M6: per sample coef = 1 when reward was skipped else kd_coef; samples
    with kd_mask > 0.5 get adv*(1-coef) + coef*kd_adv, others keep adv.
    ``kd_adv`` is already (teacher - student) * action_mask. A no-op when
    kd_coef <= 0."""
    if kd_coef <= 0:
        return adv
    coef = F.when(skip, F.lit(1.0)).otherwise(F.lit(float(kd_coef)))
    m = F.when(kd_mask > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return adv * (F.lit(1.0) - coef * m) + coef * kd_adv * m


def position_ids(tokens: DataFrame, mask_col: str = "attention_mask", packed: bool = False,
                 sample_col: str = "sample_id", t_col: str = "t", out: str = "position_id") -> DataFrame:
    """cumsum(mask) - 1; masked positions get 1 (padded form) or the value
    clipped at 0 (packed form)."""
    w = Window.partitionBy(sample_col).orderBy(t_col).rowsBetween(Window.unboundedPreceding, 0)
    p = F.sum(F.col(mask_col)).over(w) - 1
    if packed:
        return tokens.withColumn(out, F.greatest(p, F.lit(0)))
    return tokens.withColumn(out, F.when(F.col(mask_col) == 0, F.lit(1)).otherwise(p))


def next_token_shift(tokens: DataFrame, id_col: str, sample_col: str = "sample_id",
                     t_col: str = "t", out: str = "next_id") -> DataFrame:
    """The next position's value; the last position is dropped."""
    w = Window.partitionBy(sample_col).orderBy(t_col)
    return tokens.withColumn(out, F.lead(id_col).over(w)).filter(F.col(out).isNotNull())


def estimator_advantages(samples: DataFrame, tokens: DataFrame, estimator: str,
                         kl_coef: float = 0.0, kl_estimator: str = "k1", gamma: float = 1.0,
                         clip: tuple[float, float] | None = (-10.0, 10.0),
                         overlong: tuple[int, int, float] | None = None,
                         whiten_std: bool = True, cut_lineage: bool = False, kd_coef: float = 0.0) -> DataFrame:
    """M7: the estimator family end to end on token rows.

    order: overlong penalty -> group shaping -> reward clip -> token reward
    -> returns (gamma forced to 1 for group estimators) -> distillation overlay
    M6 (``kd_coef`` > 0; reads ``kd_mask`` and ``skip`` of the samples and
    ``teacher_log_prob`` of the tokens, null where there is no teacher) -> whitening
    (reinforce / reinforce_baseline only). ``kd`` is M5. Samples alone in their group
    are refused by rloo, reinforce_baseline and group_norm: their tokens get an
    ``error`` and null returns and advantages, and do not count in the whitening;
    dr_grpo gives them advantage 0. ``cut_lineage``
    writes the returns to the shared checkpoint folder before whitening."""
    if estimator == "kd":
        return kd_advantage(tokens, whiten_std=whiten_std).withColumn("error", F.lit(None).cast("string"))
    if estimator not in ("reinforce",) + GROUP_ESTIMATORS:
        raise ValueError(f"unknown advantage estimator {estimator!r}")
    s = samples
    if overlong:
        max_len, buf, factor = overlong
        s = s.withColumn("reward", overlong_penalty(F.col("reward"), F.col("response_length"),
                                                    max_len, buf, factor))
    s = group_shaping(s, estimator, out="shaped_reward")
    if estimator in PAIRED_ESTIMATORS:
        alone = F.count(F.lit(1)).over(Window.partitionBy("group_id")) < 2
        s = s.withColumn("error", F.when(alone, F.lit(f"{estimator} needs groups of two samples or more")))
    else:
        s = s.withColumn("error", F.lit(None).cast("string"))
    s = s.select("sample_id", "shaped_reward", "error")
    # the KL term is not masked here; the returns scan masks rewards
    tk = tokens.withColumn("kl", approx_kl(F.col("log_prob"), F.col("base_log_prob"), kl_estimator))
    tk = token_reward(tk, s, kl_coef, reward_col="shaped_reward", clip=clip, carry=("error",))
    g = 1.0 if estimator in GROUP_ESTIMATORS else gamma
    tk = discounted_returns(tk, g)
    # tokens of refused samples have neither returns nor advantages
    tk = tk.withColumn("returns", F.when(F.col("error").isNull(), F.col("returns"))).withColumn("advantages", F.col("returns"))
    if kd_coef > 0:
        flags = samples.select("sample_id", F.coalesce("kd_mask", F.lit(0.0)).alias("__kd"), F.coalesce("skip", F.lit(False)).alias("__skip"))
        kd = (F.col("teacher_log_prob") - F.col("log_prob")) * F.col("action_mask").cast("double")
        tk = tk.join(flags, "sample_id").withColumn("advantages", hybrid_blend(
            F.col("advantages"), F.coalesce(kd, F.lit(0.0)), F.col("__kd"), F.col("__skip"), kd_coef)).drop("__kd", "__skip")
    if cut_lineage:
        # long batches: the whitening pass and the apply pass read the written
        # returns instead of re-running the token shuffles
        from posttrain.session import materialize
        tk = materialize(tk, f"returns-{estimator}")
    if estimator in WHITENED_ESTIMATORS:
        tk = whiten(tk, "advantages", use_std=whiten_std)
    return tk
