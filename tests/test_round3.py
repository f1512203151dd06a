"""Parts of survey methods that were missing before."""

import pytest
from pyspark.sql import functions as F

from posttrain.operators import advantage, agents, distill


def test_estimator_blends_distillation_before_whitening(spark):
    samples = spark.createDataFrame([(1, 1, 1.0, 1.0, False), (2, 1, 2.0, 0.0, False), (3, 1, 0.0, 1.0, True)],
                                    "sample_id int, group_id int, reward double, kd_mask double, skip boolean")
    tokens = spark.createDataFrame([(s, t, -1.0, -1.0, -0.5 * s if s != 2 else None, 1) for s in (1, 2, 3) for t in (0, 1)],
                                   "sample_id int, t int, log_prob double, base_log_prob double, teacher_log_prob double, action_mask int")

    def run(**kw):
        return {(r["sample_id"], r["t"]): r["advantages"]
                for r in advantage.estimator_advantages(samples, tokens, "reinforce", whiten_std=False, **kw).collect()}

    plain = {1: 1.0, 2: 2.0, 3: 0.0}  # returns of a reward at the last token
    raw = {1: 0.75 * plain[1] + 0.25 * 0.5, 2: plain[2], 3: -0.5}
    mean = sum(raw.values()) / 3
    got = run(kd_coef=0.25)
    assert all(got[s, t] == pytest.approx(raw[s] - mean) for s, t in got) and len(got) == 6
    assert run()[2, 0] == pytest.approx(1.0)


def test_trajectory_arrays(spark):
    rows = [(1, 0, "user", [1, 2, 3], None), (1, 1, "assistant", [4, 5], [-0.1, -0.2]), (1, 2, "user", [6], None),
            (1, 3, "assistant", [7], [-0.3]), (2, 0, "user", [9], None)]
    d = spark.createDataFrame([(*r, 1.0, 0.5) for r in rows],
                              "conv_id int, turn int, role string, ids array<int>, action_lps array<double>, step_reward double, step_score double")
    got = {r["conv_id"]: r for r in agents.trajectory_assembly(d).collect()}
    assert got[1]["observation_tokens"] == [1, 2, 3, 4, 5, 6, 7] and got[2]["observation_tokens"] == [9]
    # values of the first action from position 0, zeros to the observation's length, then the next action's
    assert got[1]["rollout_log_probs"] == [-0.1, -0.2, 0.0, 0.0, 0.0, 0.0, -0.3] and got[2]["rollout_log_probs"] == []


def test_guided_splice_encodes_the_text_again(spark):
    d = spark.createDataFrame([(1, "ab<e>", " g", "<e>"), (2, "ab", " g", "<e>"), (3, "ab<e>", " ", "<e>"), (4, "ab", "g", "")],
                              "id int, prompt string, guide string, suffix string")
    letters = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    q = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5, 90, 91)])
    out = distill.guided_splice(q, F.when(F.col("id") == 4, 2).otherwise(5), F.array(F.lit(7)), F.array(F.lit(8)),
                                F.col("prompt"), F.col("guide"), F.col("suffix"), letters)
    got = {r["id"]: r["o"] for r in d.select("id", out.alias("o")).collect()}
    assert got[1]["ids"] == [*map(ord, "ab g<e>"), 90, 91] and (got[1]["guided_len"], got[1]["delta"], got[1]["orig_len"]) == (7, 2, 7)
    assert got[2] is None and got[3] is None
    assert got[4]["ids"] == [*map(ord, "abg"), 3, 4, 5, 90, 91] and got[4]["delta"] == 1


def test_low_coverage_warning(spark):
    t = spark.createDataFrame([(s, 0, -1.0, -0.5, 1) for s in (1, 2, 3)], "sample_id int, t int, log_prob double, teacher_log_prob double, action_mask int")
    cover = spark.createDataFrame([(1, 0.89), (2, 0.9)], "sample_id int, teacher_cov_ratio double")
    got = {r["sample_id"]: r["low_coverage_warning"] for r in distill.kd_diagnostics(t, coverage=cover).collect()}
    assert got == {1: True, 2: False, 3: False}
