"""Inputs the fixtures do not hold: NaN, failing plug-ins, odd names and files, ragged batches."""

import math
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttrain.functions import text as tx
from posttrain.functions import udf
from posttrain.operators import advantage as adv
from posttrain.operators import objectives as obj
from posttrain.operators import routing as rt
from posttrain.operators import sft
from posttrain.session import checkpoint_dir
from posttrain.sources import io


def test_nan_is_not_a_large_number(spark):
    nan = F.lit(float("nan"))
    row = spark.range(1).select(adv.clip_reward(nan).alias("r"), adv.approx_kl(nan, F.lit(0.0)).alias("k"),
                                adv.clip_reward(F.lit(None).cast("double")).alias("n"), adv.clip_reward(F.lit(99.0)).alias("c")).first()
    assert math.isnan(row.r) and math.isnan(row.k) and row.n is None and row.c == 10.0
    d = spark.createDataFrame([(1, 0, 1, float("nan"), 0.0, 1.0), (1, 1, 1, 0.0, 0.0, 1.0)],
                              "sample_id long, t int, action_mask int, log_prob double, old_log_prob double, advantages double")
    assert math.isnan(obj.policy_loss(d).first().loss)


def test_a_raising_registry_entry_scores_zero(spark):
    registry = {"bad": lambda: F.lit(1.0) / F.col("x"), "cast": lambda: F.lit("abc").cast("double"),
                "good": lambda: F.lit(0.5), "broken": lambda: 1 / 0}
    d = spark.createDataFrame([(1, "bad", 0.0), (2, "good", 0.0), (3, "cast", 0.0), (4, "broken", 0.0), (5, "bad", 2.0)],
                              "sample_id long, datasource string, x double")
    got = {r.sample_id: r.reward for r in rt.score_by_datasource(d, registry, "good").collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.5}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_reward_fn_contains_failures_per_row(spark):
    def judge(queries, prompts, labels, datasources=None, query_token_ids=None):
        if any("boom" in q for q in queries):
            raise ValueError("boom")
        return {"rewards": [float(len(q)) for q in queries], "teacher_log_probs": [[-1.0] * len(t) for t in query_token_ids]}

    rows = [(i, "boom" if i == 2 else "ok", "p", "l", "a" if i % 2 else None, [1] * i) for i in range(5)]
    d = spark.createDataFrame(rows, "id long, query string, prompt string, label string, datasource string, toks array<int>").coalesce(1)
    got = {r.id: r for r in udf.apply_reward_func(d, judge, keep=("id",), query_token_ids_col="toks").collect()}
    assert [got[i].reward for i in range(5)] == [2.0, 2.0, 0.0, 2.0, 2.0]
    assert got[2].error == "ValueError: boom" and all(got[i].error is None for i in (0, 1, 3, 4))
    assert got[3].teacher_log_probs == [-1.0] * 3 and got[2].teacher_log_probs is None


def test_scan_dir_rejects_and_any_case(spark):
    root = os.path.join(checkpoint_dir(spark), "test-src", uuid.uuid4().hex)
    os.makedirs(root)
    with open(f"{root}/b.Jsonl", "w") as f:
        f.write('{"conv_id": 1, "text": "a"}\n{"conv_id": 2, oops\n')
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("text", T.StringType())])
    assert [tuple(r) for r in io.scan_dir(spark, root, schema).select("conv_id", "text").collect()] == [(1, "a")]
    assert [r["_corrupt_record"] for r in io.scan_dir_rejects(spark, root, schema).collect()] == ['{"conv_id": 2, oops']


def test_max_count_head_keeps_rows_without_a_source(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "a")], "id long, source string")
    assert sorted(r.id for r in io.max_count_head(d, 2, "id", "source").collect()) == [1, 2, 4]
    assert sorted(r.id for r in io.max_count_head(d, 2, "id").collect()) == [1, 2]


def test_scratch_folders_are_not_shared(spark):
    assert io.scratch_dir(spark, "x") != io.scratch_dir(spark, "x")


def test_each_column_is_padded_to_its_own_width(spark):
    d = spark.createDataFrame([(0, [1, 2], [1, 2, 3]), (0, [1], [1]), (0, None, [])], "batch_id long, ids array<int>, lp array<int>")
    rows = sft.pad_sequences(d, {"ids": 0, "lp": 9}).collect()
    assert sorted(map(tuple, ((tuple(r.ids), tuple(r.lp)) for r in rows))) == [((0, 0), (9, 9, 9)), ((1, 0), (1, 9, 9)), ((1, 2), (1, 2, 3))]


def test_strip_removes_unicode_white_space(spark):
    texts = ["  a b　", "\x1ca\t", "x", "  "]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(tx.pystrip(F.col("t"))).collect()] == [t.strip() for t in texts]


@pytest.mark.parametrize("raw, want", [("all", None), (" ALL ", None), ("none", frozenset()), ("", frozenset()), (" A, b ,,", frozenset({"a", "b"}))])
def test_ds_config(raw, want):
    assert rt.parse_ds_config(raw) == want


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
