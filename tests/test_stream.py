"""Structured Streaming operators: end state equals the batch answer."""

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from posttrain.session import checkpoint_dir
from posttrain.streaming import rollouts as st


def _root(spark, name):
    return os.path.join(checkpoint_dir(spark), "test-streams", f"{name}-{uuid.uuid4().hex[:8]}")


def _write_batches(spark, root, rows, schema, batch_key):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    for b in sorted(pdf[batch_key].unique()):
        spark.createDataFrame(pdf[pdf[batch_key] == b], schema).coalesce(1).write.parquet(f"{root}/in/b{b:04d}")


def simulate_filter_accumulate(rows, n, k, lo, hi):
    pending, out, emitted = [], [], 0
    for b in sorted({r[1] for r in rows}):
        groups = {}
        for r in rows:
            if r[1] == b:
                groups.setdefault(r[2], []).append(r[6])
        for g in sorted(groups):
            s = groups[g]
            if len(s) == n and lo + 1e-6 < sum(s) / len(s) < hi - 1e-6:
                pending.append(g)
        if len(pending) >= k:
            out += [(emitted, g) for g in pending[:k]]
            pending, emitted = [], emitted + 1
    return out


def test_filter_accumulate_end_state(spark):
    import random
    r = random.Random(1)
    rows, sid = [], 0
    for b in range(6):
        for g in range(5):
            gid = b * 10 + g
            size = 4 if (b + g) % 7 else 3  # some incomplete groups
            for _ in range(size):
                rows.append((0, b, gid, sid, "ds", 0.0, r.random()))
                sid += 1
    root = _root(spark, "fa")
    schema = "run long, batch_id long, group_id long, sample_id long, datasource string, reward double, score double"
    _write_batches(spark, root, rows, schema, "batch_id")
    out = st.filter_accumulate(st.rollout_stream(spark, f"{root}/in", schema), 4, 3, (0.2, 0.8))
    st.run_to_parquet(out, "fa", f"{root}/out", checkpoint=f"{root}/ck")
    got = sorted((x.emit_step, x.group_id) for x in spark.read.parquet(f"{root}/out").collect())
    assert got == sorted(simulate_filter_accumulate(rows, 4, 3, 0.2, 0.8))


def test_adaptive_kl_stream_equals_batch(spark):
    rows = [(0, s, 0.1 + (s % 5) * 0.05, 2) for s in range(40)] + [(1, s, 0.5, 1) for s in range(40)]
    root = _root(spark, "kl")
    pdf = pd.DataFrame(rows, columns=["run", "step", "kl", "n_steps"])
    pdf["chunk"] = pdf["step"] // 10
    for c in sorted(pdf["chunk"].unique()):
        spark.createDataFrame(pdf[pdf["chunk"] == c].drop(columns="chunk"),
                              "run long, step long, kl double, n_steps long").coalesce(1).write.parquet(f"{root}/in/c{c}")
    s = spark.readStream.schema("run long, step long, kl double, n_steps long").option(
        "maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    st.run_to_parquet(st.adaptive_kl_stream(s, 0.1, 0.3, 100), "kl", f"{root}/out", checkpoint=f"{root}/ck")
    last = {r.run: r.v for r in spark.read.parquet(f"{root}/out").groupBy("run").agg(
        F.max_by("kl_coef", "step").alias("v")).collect()}
    batch = {r.run: r.kl_coef for r in st.adaptive_kl_batch(
        spark.createDataFrame(rows, "run long, step long, kl double, n_steps long"), 0.1, 0.3, 100).collect()}
    v = 0.1
    for _, _, kl, n in rows[:40]:
        v *= 1 + min(max(kl / 0.3 - 1, -0.2), 0.2) * n / 100
    assert abs(batch[0] - v) < 1e-12
    assert abs(last[0] - batch[0]) < 1e-12 and abs(last[1] - batch[1]) < 1e-12


def test_resume_processes_only_new_files(spark):
    root = _root(spark, "rs")
    schema = "run long, batch_id long, group_id long, sample_id long, datasource string, reward double, score double"
    rows = [(0, b, b, b * 10 + i, "a" if i % 2 else "b", float(i - 2), 0.5) for b in range(4) for i in range(5)]
    _write_batches(spark, root, [r for r in rows if r[1] < 2], schema, "batch_id")
    agg = st.running_datasource_stats(st.rollout_stream(spark, f"{root}/in", schema))
    st.run_to_parquet(agg, "rs", f"{root}/out", mode="complete", checkpoint=f"{root}/ck")
    first = {r.datasource: r["count"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert sum(first.values()) == 10
    _write_batches(spark, root, [r for r in rows if r[1] >= 2], schema, "batch_id")
    agg = st.running_datasource_stats(st.rollout_stream(spark, f"{root}/in", schema))
    st.run_to_parquet(agg, "rs", f"{root}/out", mode="complete", checkpoint=f"{root}/ck")
    final = {r.datasource: (r["count"], r.passed) for r in spark.read.parquet(f"{root}/out").collect()}
    assert sum(c for c, _ in final.values()) == 20
    assert final == {"a": (8, 4), "b": (12, 4)}


def test_fifo_buffer_takes_the_batches_of_one_file_one_by_one(spark):
    schema = "run long, batch_id long, group_id long, sample_id long, datasource string, reward double, score double"
    rows = [(0, b, b, b * 10 + i, "a", 0.0, 0.5) for b in range(6) for i in range(5)]
    root = _root(spark, "fb")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in")
    out = st.fifo_buffer(st.rollout_stream(spark, f"{root}/in", schema), limit=7, appends_per_step=2)
    st.run_to_parquet(out, "fb", f"{root}/out", checkpoint=f"{root}/ck")
    got = sorted((x.step, x.sample_id) for x in spark.read.parquet(f"{root}/out").collect())
    assert got == [(s, x) for s in range(3) for x in [s * 20 + 3, s * 20 + 4, *range(s * 20 + 10, s * 20 + 15)]]


def test_filter_accumulate_takes_the_batches_of_one_file_one_by_one(spark):
    schema = "run long, batch_id long, group_id long, sample_id long, datasource string, reward double, score double"
    rows = [(0, b, b * 10 + g, b * 100 + g * 4 + i, "ds", 0.0, 0.1 * (g + 1)) for b in range(5) for g in range(5) for i in range(4)]
    root = _root(spark, "fo")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in")
    out = st.filter_accumulate(st.rollout_stream(spark, f"{root}/in", schema), 4, 6, (0.15, 0.45))
    st.run_to_parquet(out, "fo", f"{root}/out", checkpoint=f"{root}/ck")
    got = sorted((x.emit_step, x.group_id) for x in spark.read.parquet(f"{root}/out").collect())
    want = sorted(simulate_filter_accumulate(rows, 4, 6, 0.15, 0.45))
    assert got == want and len(want) == 12


def _files_in_order_of_time(path):
    names = [(os.stat(os.path.join(d, f)).st_mtime, os.path.basename(d)) for d, _, fs in os.walk(path) for f in fs
             if f.endswith(".parquet")]
    return [d for _, d in sorted(names)]


def test_replayed_files_arrive_in_order_from_one_write(spark):
    from posttrain.plans.q_stream import _arrive
    root = _root(spark, "ar")
    rows = spark.range(300).select(F.when(F.col("id") % 30 != 29, F.col("id") % 30).alias("batch_id"), "id").repartition(7)
    _arrive(rows, F.col("batch_id"), f"{root}/in")
    assert _files_in_order_of_time(f"{root}/in") == [f"file={b}" for b in range(29)] + ["file=__HIVE_DEFAULT_PARTITION__"]
    back = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/in")
    assert sorted(r.id for r in back.collect()) == list(range(300))
    s = spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    met = []
    q = s.writeStream.option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).foreachBatch(
        lambda b, i: met.append([r.batch_id for r in b.select("batch_id").distinct().collect()])).start()
    q.awaitTermination()
    assert met == [[b] for b in range(29)] + [[None]]


def test_replay_keeps_whole_batches_in_a_file(spark, tmp_path):
    from posttrain.plans.q_stream import _replay
    rows = spark.range(200).select((F.col("id") % 10).alias("batch_id"), "id")
    _replay(rows.where("batch_id < 5"), str(tmp_path), per_file=4)
    _replay(rows.where("batch_id >= 5"), str(tmp_path), per_file=4)
    back = spark.read.parquet(f"{tmp_path}/in")
    assert back.count() == 200
    assert sorted((r.file, r.n) for r in back.groupBy("file").agg(F.countDistinct("batch_id").alias("n")).collect()) == [(0, 4), (1, 4), (2, 2)]


def _bounded_pipeline_takes(spark, tmp_path, users):
    from posttrain.plans.q_stream import q_bounded_pipeline
    rows = [(4 * u + i, u, "click", 10.0 * i) for u in users for i in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    streams = os.path.join(checkpoint_dir(spark), "streams")
    before = {d for d in os.listdir(streams)} if os.path.isdir(streams) else set()
    got = sorted((r.micro_batch, r.n_rows, r.gen_batch) for r in q_bounded_pipeline(spark, str(tmp_path)).collect())
    (made,) = [d for d in os.listdir(streams) if d not in before and d.startswith("r3-")]
    return got, sum(f.isdigit() for f in os.listdir(f"{streams}/{made}/ck/commits"))


def test_bounded_pipeline_takes_the_batches_of_one_file_one_by_one(spark, tmp_path):
    users = [u for u in range(1300) if u // 10 % 7 != 3 and (u < 900 or u % 10 < 4)]
    got, triggers = _bounded_pipeline_takes(spark, tmp_path, users)
    sizes = {}
    for u in users:
        sizes[u // 10] = sizes.get(u // 10, 0) + 4
    assert got == [(i, sizes[b], b) for i, b in enumerate(sorted(sizes))]
    assert triggers == 3  # not one for each of more than a hundred generation batches


def test_reports_run_on_over_triggers_and_restarts(spark):
    schema = "run long, batch_id long, group_id long, sample_id long, datasource string, reward double, score double"
    rows = [(0, b, b, b * 10 + i, "a", 0.0, 0.5) for b in range(9) for i in range(b + 1)]
    rows += [(0, None, 99, 990, "a", 0.0, 0.5)]
    root = _root(spark, "bp")

    def arrive(part, name):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).coalesce(1).write.parquet(f"{root}/in/{name}")
        st.report_batches(st.rollout_stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/ck")
        back = spark.read.schema(st._R3_OUT).option("recursiveFileLookup", "true").parquet(f"{root}/out")
        return sorted((r.micro_batch, r.gen_batch, r.n_rows) for r in back.collect())
    assert arrive((0, 1, 2), "a") == [(b, b, b + 1) for b in range(3)]
    assert arrive((3, 4, 5), "b") == [(b, b, b + 1) for b in range(6)]
    assert arrive((6, 7, 8, None), "c") == [(b, b, b + 1) for b in range(9)] + [(9, None, 1)]
