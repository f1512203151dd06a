"""Objectives over logged logit arrays (M20-M24) and top-k routing.

Each row carries a logits array. Reductions over the array are single-pass
``aggregate`` folds with an online max (log-sum-exp without a second pass);
no lambda reads an outer array expression, so every row costs O(width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttrain.operators.index import keyed_row_number

IGNORE_INDEX = -100
NEG_INF = float("-inf")


def _as_double(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def _lse_step(st, x):
    """One step of the online log-sum-exp fold: state (max, sum exp(x - max),
    sum exp(x - max) * x), rescaled when the max grows."""
    m2 = F.greatest(st["m"], x)
    scale = F.when(st["m"] == F.lit(NEG_INF), F.lit(0.0)).otherwise(F.exp(st["m"] - m2))
    e = F.exp(x - m2)
    return F.struct(m2.alias("m"), (st["s"] * scale + e).alias("s"), (st["t"] * scale + e * x).alias("t"))


def _lse_state(arr: Column) -> Column:
    init = F.struct(F.lit(NEG_INF).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    return F.aggregate(_as_double(arr), init, _lse_step)


def logsumexp(arr: Column) -> Column:
    st = _lse_state(arr)
    return st["m"] + F.log(st["s"])


def entropy(logits: Column) -> Column:
    """logsumexp(x) - sum(softmax(x) * x)."""
    return F.aggregate(_as_double(logits), F.struct(F.lit(NEG_INF).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")),
                       _lse_step, lambda st: st["m"] + F.log(st["s"]) - st["t"] / st["s"])


def token_logprob(logits: Column, label: Column, temperature: float = 1.0) -> Column:
    """logit[label]/T - logsumexp(logits/T) (label is 0-based)."""
    scaled = F.transform(_as_double(logits), lambda x: x / F.lit(float(temperature)))
    return F.element_at(scaled, label + 1) - logsumexp(scaled)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label]; null when label is the ignore index."""
    return F.when(label != IGNORE_INDEX, logsumexp(logits) - F.element_at(_as_double(logits), label + 1))


def lm_cross_entropy(rows: DataFrame, seq_col: str, pos_col: str, logits_col: str = "logits",
                     label_col: str = "label") -> DataFrame:
    """Next-token loss: the logits at position t score the label at t+1
    (the last position has none); labels equal to -100 are ignored; mean over
    the rest. One output row ``loss``."""
    from pyspark.sql import Window
    nxt = F.lead(label_col).over(Window.partitionBy(seq_col).orderBy(pos_col))
    d = rows.withColumn("__next", nxt).filter(F.col("__next").isNotNull())
    return d.agg(F.avg(cross_entropy(F.col(logits_col), F.col("__next"))).alias("loss"))


def kd_token_loss(student: Column, teacher: Column) -> Column:
    """M21 per position: sum_i softmax(teacher)_i * log_softmax(student)_i with
    positions where the student logit is infinite contributing 0. Computed as
    sum(p_t * s) - lse(s) * sum(p_t over finite s), one fold per array."""
    pairs = F.arrays_zip(_as_double(teacher).alias("t"), _as_double(student).alias("s"))
    init = F.struct(F.lit(NEG_INF).alias("m"), F.lit(0.0).alias("z"), F.lit(0.0).alias("u"), F.lit(0.0).alias("f"))

    def step(st, e):
        t, s = e["t"], e["s"]
        fin = F.abs(s) < F.lit(float("inf"))
        m2 = F.greatest(st["m"], t)
        scale = F.when(st["m"] == F.lit(NEG_INF), F.lit(0.0)).otherwise(F.exp(st["m"] - m2))
        w = F.exp(t - m2)
        return F.struct(m2.alias("m"), (st["z"] * scale + w).alias("z"),
                        (st["u"] * scale + F.when(fin, w * s).otherwise(F.lit(0.0))).alias("u"),
                        (st["f"] * scale + F.when(fin, w).otherwise(F.lit(0.0))).alias("f"))

    st = F.aggregate(pairs, init, step)
    return st["u"] / st["z"] - logsumexp(F.filter(_as_double(student), lambda x: F.abs(x) < F.lit(float("inf")))) * (
        st["f"] / st["z"])


def kd_cross_entropy(rows: DataFrame, student_col: str, teacher_col: str, label_col: str) -> DataFrame:
    """-sum over positions with label != -100 of the per-position value,
    divided by the number of such positions."""
    m = (F.col(label_col) != IGNORE_INDEX).cast("double")
    x = kd_token_loss(F.col(student_col), F.col(teacher_col))
    return rows.agg((-F.sum(x * m) / F.sum(m)).alias("loss"))


def step_label_loss(rows: DataFrame, input_col: str, logits_col: str, label_col: str, placeholder_id: int,
                    reward_token_ids: tuple[int, int]) -> DataFrame:
    """M22 (hard labels): keep placeholder positions, restrict logits to the
    reward tokens, map labels to their index there; cross entropy over the
    non-ignored positions and argmax accuracy."""
    a, b = reward_token_ids
    d = rows.filter(F.col(input_col) == placeholder_id)
    two = F.array(F.element_at(logits_col, a + 1).cast("double"), F.element_at(logits_col, b + 1).cast("double"))
    lab = F.when(F.col(label_col) == a, F.lit(0)).when(F.col(label_col) == b, F.lit(1)).otherwise(F.col(label_col))
    d = d.select(two.alias("__l"), lab.alias("__y"))
    ce = cross_entropy(F.col("__l"), F.col("__y"))
    pred = F.when(F.element_at("__l", 2) > F.element_at("__l", 1), F.lit(1)).otherwise(F.lit(0))
    return d.agg(F.avg(ce).alias("loss"), F.avg(F.when(pred == F.col("__y"), 1.0).otherwise(0.0)).alias("acc"))


def step_label_loss_soft(rows: DataFrame, input_col: str, logits_col: str, prob_col: str, placeholder_id: int,
                         reward_token_ids: tuple[int, int]) -> DataFrame:
    """M22 (soft labels): at placeholder positions the target is the pair
    (p, 1 - p) over the two reward tokens; soft cross entropy and argmax
    accuracy against the larger target."""
    a, b = reward_token_ids
    d = rows.filter(F.col(input_col) == placeholder_id).select(
        F.element_at(logits_col, a + 1).cast("double").alias("__a"),
        F.element_at(logits_col, b + 1).cast("double").alias("__b"), F.col(prob_col).cast("double").alias("__p"))
    m = F.greatest("__a", "__b")
    lse = m + F.log(F.exp(F.col("__a") - m) + F.exp(F.col("__b") - m))
    ce = -(F.col("__p") * (F.col("__a") - lse) + (F.lit(1.0) - F.col("__p")) * (F.col("__b") - lse))
    pred = F.when(F.col("__b") > F.col("__a"), 1).otherwise(0)
    target = F.when((F.lit(1.0) - F.col("__p")) > F.col("__p"), 1).otherwise(0)
    return d.agg(F.avg(ce).alias("loss"), F.avg(F.when(pred == target, 1.0).otherwise(0.0)).alias("acc"))


def topk_gate(logits: Column, k: int, noise: Column | None = None, noise_logits: Column | None = None) -> Column:
    """Top-k entries of each row (ties: lower index first), softmax over
    the kept values, 0 elsewhere. Noisy variant: logits + noise *
    softplus(noise_logits), with the noise given as a column. Returns
    array<struct<idx:int, weight:double>> in descending value order."""
    x = _as_double(logits)
    if noise is not None:
        soft = F.transform(_as_double(noise_logits), lambda v: F.log1p(F.exp(-F.abs(v))) + F.greatest(v, F.lit(0.0)))
        x = F.zip_with(F.zip_with(x, _as_double(noise), lambda a, n: F.struct(a.alias("a"), n.alias("n"))), soft,
                       lambda p, s: p["a"] + p["n"] * s)
    ranked = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), (-i).alias("neg_i"))), asc=False)
    top = F.slice(ranked, 1, k)
    init = F.struct(F.lit(NEG_INF).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    # the finish step sees the folded (max, sum) once per row
    return F.aggregate(F.transform(top, lambda e: e["v"]), init, _lse_step,
                       lambda st: F.transform(top, lambda e: F.struct(
                           (-e["neg_i"]).alias("idx"), (F.exp(e["v"] - st["m"]) / st["s"]).alias("weight"))))


def expert_capacity(routes: DataFrame, n_experts: int, k: int, factor: float, id_col: str,
                    gate_col: str = "gate", bounds: DataFrame | None = None) -> DataFrame:
    """One row per (row, chosen expert); each expert keeps its first
    int(B*k/E*factor) rows by ``id_col``. Position inside an expert uses the
    skew-safe keyed row number, so a popular expert is not one task."""
    d = routes.select(id_col, F.posexplode(gate_col).alias("rank", "g")).select(
        id_col, "rank", F.col("g.idx").alias("expert"), F.col("g.weight").alias("weight"))
    n = routes.agg(F.count(F.lit(1))).scalar()
    d = keyed_row_number(d, ["expert"], id_col, out="pos_in_expert",
                         bounds=bounds if bounds is not None else routes.select(id_col))
    cap = F.floor(n * F.lit(k) / F.lit(n_experts) * F.lit(factor))
    return d.filter(F.col("pos_in_expert") < cap)
