"""Two-level positions, affine return scans, signed coefficients, refused groups."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from posttrain.operators import advantage as adv
from posttrain.operators import index
from posttrain.streaming import rollouts as st


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_buckets_are_cut_in_two_levels(spark):
    d = spark.range(60_000).select("id", ((F.col("id") * 7919) % 30_011).alias("o")).repartition(9)
    got = index.global_index(d, "o", tiebreak=["id"], buckets=4096)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in text and "TakeOrdered" not in _plan(got)
    sizes = [r["n"] for r in index.range_bucket(d, ["o", "id"], 4096).groupBy("__bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 2500 and max(sizes) < 150  # 15 rows a bucket on average
    want = d.select("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o", "id")) - 1).alias("w"))
    assert got.join(want, "id").where("_seq <> w").count() == 0 and got.count() == 60_000


def test_two_levels_with_hot_keys_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(index, "COARSE", 4)
    rows = [(i, None if i % 5 == 0 else 1 if i % 3 else i % 40, None if i % 7 == 0 else float(i % 90)) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, k long, o double").repartition(6)
    w = Window.partitionBy("k").orderBy("o", "id")
    want = {r["id"]: (r["n"], r["s"]) for r in d.select("id", (F.row_number().over(w) - 1).alias("n"), F.coalesce(
        F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s")).collect()}
    got = index.keyed_row_number(d, ["k"], "o", tiebreak=["id"], out="n", buckets=50)
    got = index.keyed_prefix_sums(got, ["k"], "o", {"s": "id"}, tiebreak=["id"], buckets=50)
    assert {r["id"]: (r["n"], r["s"]) for r in got.collect()} == want


@pytest.mark.parametrize(("gamma", "n"), [(0.5, 10_000), (0.99, 3_000), (0.001, 700)])
def test_discounted_returns_over_many_blocks(spark, gamma, n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    x[n // 10:n - 3] = 0.0  # far terms alone decide most of the returns
    x[-1] = 1e250
    mask = (rng.random(n) < 0.9).astype(int)
    mask[-1] = 1
    d = spark.createDataFrame([(1, i, int(mask[i]), float(x[i])) for i in range(n)], "sample_id long, t int, action_mask int, token_reward double")
    got = [r["returns"] for r in adv.discounted_returns(d, gamma).orderBy("t").collect()]
    want, acc = [0.0] * n, 0.0
    for i in range(n - 1, -1, -1):
        acc = mask[i] * x[i] + gamma * acc
        want[i] = acc
    assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-290) for a, b in zip(got, want, strict=True))


def test_discounted_returns_of_sparse_positions_in_one_scan(spark):
    at = [0, 3, 1200, 1201, 2500, 9000]
    d = spark.createDataFrame([(s, t, 1, float(t + s)) for s in (1, 2) for t in at], "sample_id long, t int, action_mask int, token_reward double")
    got = adv.discounted_returns(d, 0.5)
    for r in got.collect():
        want = sum(0.5 ** (u - r["t"]) * (u + r["sample_id"]) for u in at if u >= r["t"])
        assert math.isclose(r["returns"], want, rel_tol=1e-12)
    assert "Join" not in _plan(got)


def test_coefficient_trace_with_factors_of_any_sign(spark):
    rng = np.random.default_rng(4)
    rows = [(run, step, float(rng.choice([0.0, 0.3, 0.9, 0.25])), int(rng.integers(1, 14) if run else rng.integers(1, 9)))
            for run in range(6) for step in range(60)]
    rows.append((9, 0, 0.0, 10))  # a factor of exactly 0
    rows += [(9, s, 0.9, 3) for s in range(1, 5)] + [(8, 0, 0.24, 0), (8, 1, 0.0, 12), (8, 2, 0.3, 4)]
    df = spark.createDataFrame(rows, "run long, step long, kl double, n_steps long").repartition(5)
    got = {(r["run"], r["step"]): r["kl_coef"] for r in st.adaptive_kl_trace(df, 0.05, 0.3, 2).collect()}
    value = {}
    for run, step, kl, n in sorted(rows):
        v = value.get(run, 0.05) * (1 + min(max(kl / 0.3 - 1, -0.2), 0.2) * n / 2)
        value[run] = v
        assert math.isclose(got[run, step], v, rel_tol=1e-9, abs_tol=1e-300), (run, step)
    assert any(v < 0 for v in got.values()) and got[9, 4] == 0


@pytest.mark.parametrize("estimator", ["rloo", "reinforce_baseline", "group_norm", "dr_grpo", "reinforce"])
def test_groups_of_one(spark, estimator):
    samples = spark.createDataFrame([(1, 10, 1.0), (2, 10, 0.0), (3, 11, 5.0)], "sample_id long, group_id long, reward double")
    tokens = spark.createDataFrame([(s, t, 1, -1.0, -1.0) for s in (1, 2, 3) for t in (0, 1)],
                                   "sample_id long, t int, action_mask int, log_prob double, base_log_prob double")
    rows = adv.estimator_advantages(samples, tokens, estimator).collect()
    alone = [r for r in rows if r["sample_id"] == 3]
    if estimator in adv.PAIRED_ESTIMATORS:
        assert all(r["advantages"] is None and r["returns"] is None and estimator in r["error"] for r in alone)
    else:
        assert all(r["error"] is None and r["advantages"] is not None for r in alone)
    pair = sorted((r["sample_id"], r["advantages"]) for r in rows if r["sample_id"] < 3)
    assert all(a is not None for _, a in pair) and pair[0][1] > pair[-1][1]
    if estimator == "dr_grpo":
        assert all(r["advantages"] == 0 for r in alone)
    if estimator == "reinforce_baseline":  # whitened over the two samples that count
        assert math.isclose(pair[0][1], 1.0, rel_tol=1e-9) and math.isclose(pair[-1][1], -1.0, rel_tol=1e-9)


# --- guided batches, vocabulary, merged batches

def test_guided_batch_has_all_outcomes(spark):
    from pyspark.sql import Column

    from posttrain.operators import distill

    def encode(text: Column) -> Column:  # one id a word: its length
        return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w).cast("int"))

    def teacher(ids: Column) -> Column:  # no answer for 9 ids, one value short for 10
        n = F.size(ids)
        return F.when(n != 9, F.transform(F.slice(ids, 2, F.greatest(n - 1 - (n == 10).cast("int"), F.lit(0))), lambda x: x.cast("double")))

    rows = [("guided", [1, 2, 5, 7, 7], "a bb sssss", "gg ", 6, True),             # ids 1 2 2 5 7 7: spliced
            ("again", [1, 2, 9, 7], "a bb sssss", "gg ", 3, True),                 # prompt cut at the common prefix: encoded again
            ("fallback", [1, 2, 3, 4, 5, 6, 5, 8], "a bb ccc dddd eeeee ffffff sssss", "gg ", 7, True),  # 9 guided ids: the plain answer
            ("failed", [1, 2, 3, 4, 5, 6, 7, 5], "a bb ccc dddd eeeee ffffff ggggggg sssss", "gg ", 7, True),  # no response at all
            ("short", [1, 2, 3, 4, 5, 6, 7, 5, 8], "a bb ccc dddd eeeee ffffff ggggggg sssss", "gg ", 8, True),  # neither counts
            ("blank", [1, 5, 4], "a sssss", "  ", 2, True), ("off", [1, 5, 4], "a sssss", "gg ", 2, False)]
    df = spark.createDataFrame(rows, "k string, query_ids array<int>, prompt string, label string, mask_len int, on boolean")
    got = {r["k"]: r for r in distill.guided_batch(df, teacher, encode, " sssss", guide_prefix=" ", enabled=F.col("on"), mask_len_col="mask_len").collect()}
    flags = {k: (r["guide_applied"], r["guide_fallback"], r["kd_valid"]) for k, r in got.items()}
    assert flags == {"guided": (1, 0, 1), "again": (1, 0, 1), "fallback": (0, 1, 1), "failed": (0, 1, 1), "short": (0, 1, 0), "blank": (0, 0, 1), "off": (0, 0, 1)}
    assert got["guided"]["teacher_log_probs"] == [0, 0, 7, 7, 0, 0]
    assert got["again"]["teacher_log_probs"] == [0, 9, 7]
    assert got["fallback"]["teacher_log_probs"] == [2, 3, 4, 5, 6, 5, 8]
    assert got["short"]["teacher_log_probs"] == [0] * 8
    assert got["blank"]["teacher_log_probs"] == got["off"]["teacher_log_probs"] == [5, 4]


def test_vocabulary_round_trip(spark):
    from posttrain.operators import vocab
    texts = [(0, "the cat, the dog\n the  end"), (1, None), (2, ""), (3, "čaj и чай ☕ 中文 the"), (4, " \t\x0b x"), (5, "rare"), (5, "the the")]
    df = spark.createDataFrame([(i, j, t) for j, (i, t) in enumerate(texts)], "id long, no long, text string").repartition(3)
    words = vocab.build_vocabulary(df)
    ids = [r["id"] for r in words.orderBy(F.desc("n"), "piece").collect()]
    assert ids == list(range(1, len(ids) + 1))
    back = vocab.decode(vocab.encode(df, words, ["id", "no"]), words, ["id", "no"])
    assert sorted((r["no"], r["text"]) for r in back.collect()) == [(j, t or "") for j, (_, t) in enumerate(texts)]
    few = vocab.build_vocabulary(df, min_count=2)
    cut = vocab.encode(df, few, ["no"], max_length=3)
    got = {r["no"]: r["text"] for r in vocab.decode(cut, few, ["no"], unknown="?").collect()}
    assert got[0] == "the ?" and got[5] == "?" and got[6] == "the the" and got[1] == ""
    assert all(x >= 0 for r in cut.collect() for x in r["ids"])


def test_rows_of_unequal_batches_are_quarantined(spark):
    from posttrain.operators.batching import row_explode
    df = spark.createDataFrame([(1, [1, 2], ["a", None]), (2, [1], ["a", "b"]), (3, [], []), (4, None, None), (5, None, ["x"])], "b long, x array<int>, y array<string>")
    got = sorted(tuple(r) for r in row_explode(df, ["x", "y"], ["b"]).fillna("-", ["error"]).collect())
    assert [g for g in got if g[0] == 1] == [(1, 0, 1, "a", "-"), (1, 1, 2, None, "-")]
    assert [g[0] for g in got] == [1, 1, 2, 5]
    assert [g[4] for g in got if g[0] in (2, 5)] == ["x: 1, y: 2", "x: 0, y: 1"] and all(g[1] is None for g in got if g[0] == 2)


def test_merged_experiences(spark):
    from posttrain.operators.batching import merge_experiences
    rows = [(0, 1, [[1, 2], [3]], ["p"], {"b": [1.0], "a": [2.0]}), (0, 0, [[4, 5, 6]], ["q", "r"], {"b": [3.0, 4.0]}), (0, 2, None, None, None), (1, 0, [[]], [], {})]
    df = spark.createDataFrame(rows, "g long, o long, s array<array<int>>, l array<string>, m map<string, array<double>>")
    got = {r["g"]: r for r in merge_experiences(df, "g", "o", pad={"s": 9}, lists=("l",), maps=("m",)).collect()}
    assert got[0]["s"] == [[4, 5, 6], [1, 2, 9], [3, 9, 9]] and got[0]["l"] == ["q", "r", "p"]
    assert got[0]["m"] == {"a": [2.0], "b": [3.0, 4.0, 1.0]} and got[1]["s"] == [[]] and got[1]["m"] == {}


# --- sources, draws, resume

def test_lines_of_split_files_are_numbered(spark, tmp_path):
    from pyspark.sql import types as T

    from posttrain.sources import io
    (tmp_path / "in").mkdir()
    for name in ("a.jsonl", "b.JSONL"):
        with open(tmp_path / "in" / name, "w") as f:
            for i in range(900):
                f.write("\n" if i % 50 == 7 else f'{{"i": {i}, oops\n' if i % 90 == 3 else f'{{"i": {i}}}\n')
    (tmp_path / "in" / "c.parquet").write_bytes(b"not parquet")
    schema = T._parse_datatype_string("i long")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = io.scan_dir(spark, str(tmp_path / "in"), schema)
        assert rows.where("_row <> i").count() == 0 and rows.count() == 2 * len([i for i in range(900) if i % 50 != 7 and i % 90 != 3])
        bad = io.scan_dir_rejects(spark, str(tmp_path / "in"), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["_row"] for r in bad if r["reason"] == "malformed line") == sorted(2 * [i for i in range(900) if i % 90 == 3 and i % 50 != 7])
    assert [r["_file"].rpartition("/")[2] for r in bad if r["reason"] == "no readable rows"] == ["c.parquet"]


def test_draws_need_no_job_and_no_hot_key(spark):
    from posttrain.operators.blend import interleave
    sources = spark.range(2001).select(F.col("id"), F.when(F.col("id") == 0, 1).otherwise(0).alias("source_idx"))
    failing = sources.withColumn("id", F.when(F.assert_true(F.col("id") < 0).isNull(), F.col("id")))
    interleave(spark, failing, [0.5, 0.5])  # builds without running
    got = interleave(spark, sources, [0.5, 0.5]).collect()
    draws = sorted(r["draw"] for r in got)
    assert draws == list(range(len(draws))) and len(draws) > 3500
    small = [r for r in got if r["source_idx"] == 1]
    assert {r["id"] for r in small} == {0} and abs(len(small) / len(got) - 0.5) < 0.05
    first = [r["id"] for r in sorted(got, key=lambda r: r["draw"]) if r["source_idx"] == 0]
    assert first == list(range(1, 2001))
    with pytest.raises(Exception, match="at least one row"):
        interleave(spark, sources.where("source_idx = 0"), [0.5, 0.5]).collect()


def test_a_run_that_dies_before_its_commit_is_done_again(spark, tmp_path):
    samples = spark.range(101).withColumnRenamed("id", "sample_id")
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert st.run_steps(samples, whole, "sample_id", replicas=2, per_rank=5, episodes=2, seed=3)
    assert not st.run_steps(samples, parts, "sample_id", replicas=2, per_rank=5, episodes=2, seed=3, max_steps=4)
    assert st.load_state(spark, parts) == (4, 0, 40, 0)
    # rows of batch 1 without their state: as after a crash
    spark.read.parquet(f"{parts}/steps/batch_id=0").write.parquet(f"{parts}/steps/batch_id=1")
    assert not st.run_steps(samples, parts, "sample_id", replicas=2, per_rank=5, episodes=2, seed=3, max_steps=9)
    assert st.run_steps(samples, parts, "sample_id", replicas=2, per_rank=5, episodes=2, seed=3)
    cols = ["global_step", "episode", "rank", "slot", "sample_id"]

    def rows(path):
        return sorted(tuple(r) for r in spark.read.parquet(f"{path}/steps").select(*cols).collect())

    assert rows(whole) == rows(parts) and len(rows(whole)) == 200
    assert st.run_steps(samples, parts, "sample_id", replicas=2, per_rank=5, episodes=2, seed=3)  # nothing is left to do
    assert rows(parts) == rows(whole)


def test_typed_info_is_checked_by_batch(spark):
    from posttrain.operators import batching as bt
    rows = [("a", 1, '{"n": 1, "s": "x", "f": 1.5, "o": {"z": 1}, "l": [1], "e": null}'), ("a", 2, '{"n": true, "s": "y", "f": 2e0, "o": {}, "l": [], "e": null, "later": 1}'),
            ("b", 1, '{"n": true, "m": 1}'), ("b", 2, '{"n": 1, "m": 1.0}'), ("c", 1, '{"n": 7}'), ("c", 2, "broken"), ("c", 3, None),
            ("d", 1, None), ("d", 2, '{"n": 7}')]
    d = spark.createDataFrame(rows, "b string, o int, info string")
    got = {(r["b"], r["key"]): (r["kind"], r["numbers"], r["texts"], r["error"]) for r in bt.collate_typed_info(d, "b", "o", "info").collect()}
    assert got == {
        ("a", "n"): ("int", [1.0, 1.0], None, None), ("a", "s"): ("str", None, ['"x"', '"y"'], None),
        ("a", "f"): ("float", [1.5, 2.0], None, None), ("a", "o"): ("map", None, ['{"z":1}', "{}"], None),
        ("a", "l"): ("list", None, ["[1]", "[]"], None), ("a", "e"): ("null", None, ["null", "null"], None),
        ("b", "n"): ("bool", None, None, "inconsistent types: bool, int"), ("b", "m"): ("int", None, None, "inconsistent types: float, int"),
        ("c", "n"): ("int", None, None, "missing in 2 rows")}
