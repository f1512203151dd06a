"""Query keys for the incremental loop (R1-R6, S12) and blending.

Streaming keys replay the rollouts as files into the shared checkpoint folder, run the
stream to the end of the input (``availableNow``), one file a trigger, and return what
the sink holds. A file holds ``FILE_BATCHES`` whole generation batches, which the
operators take one by one."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from posttrain.operators import blend
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import checkpoint_dir, table
from posttrain.streaming import rollouts as st

R = ("fx_rollouts",)
N_RUNS = 2  # runs in the replay: prompt parity
#: Generation batches, and steps of the KL log, that arrive in one file.
FILE_BATCHES, FILE_STEPS = 64, 160_000
SCHEMA = ("run long, batch_id long, group_id long, sample_id long, datasource string, "
          "reward double, score double")


def _fresh(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _arrive(rows, number, path: str) -> None:
    """Add ``rows`` to ``path``, one file for each value of ``number`` (whole numbers, null
    last), by one write. A file source takes files by their times, so each file is
    dated a second after the one before it."""
    spark = rows.sparkSession
    rows.withColumn("file", number).repartitionByRange("file").sortWithinPartitions("file").write.partitionBy("file").mode("append").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []  # name and time of each file
    for f in fs.globStatus(hadoop.Path(folder, "file=*/*.parquet")):
        value = f.getPath().getParent().getName().removeprefix("file=")
        found.append((float("inf") if value.startswith("__") else int(value), f.getPath(), f.getModificationTime()))
    base = min((t for *_, t in found), default=0) // 1000 * 1000
    for i, (_, name, _) in enumerate(sorted(found, key=lambda x: x[0])):
        fs.setTimes(name, base + 1000 * i, -1)
        if fs.getFileStatus(name).getModificationTime() != base + 1000 * i:
            raise RuntimeError(f"{path}: this file system keeps no file times, so files would not arrive in order")


def _rollouts(spark, sf):
    """fx_rollouts in generation batches (10 prompts' users per batch), runs by user parity."""
    return fx.fx_rollouts(spark, sf).select(
        (F.col("prompt_id") % 2).alias("run"), (F.floor(F.col("prompt_id") / 10)).cast("long").alias("batch_id"),
        "group_id", "sample_id", "datasource", (F.col("raw_score") - F.lit(0.3)).alias("reward"),
        F.col("raw_score").alias("score"))


def _replay(rows, root: str, per_file: int = FILE_BATCHES) -> None:
    _arrive(rows, F.floor(F.col("batch_id") / per_file), f"{root}/in")


def _stream(spark, root):
    return st.rollout_stream(spark, f"{root}/in", SCHEMA, max_files_per_trigger=1)


@query("filter_accumulate")
def q_filter_accumulate(spark, sf):
    root = _fresh(spark, "r1")
    _replay(_rollouts(spark, sf), root)
    out = st.filter_accumulate(_stream(spark, root), 4, 40, (0.2, 0.6))
    st.run_to_parquet(out, "r1", f"{root}/out", checkpoint=f"{root}/ck", state_partitions=N_RUNS)
    return spark.read.schema(st._R1_OUT).parquet(f"{root}/out")


@query("fifo_buffer")
def q_fifo_buffer(spark, sf):
    root = _fresh(spark, "r2")
    _replay(_rollouts(spark, sf), root)
    out = st.fifo_buffer(_stream(spark, root), limit=300, appends_per_step=2)
    st.run_to_parquet(out, "r2", f"{root}/out", checkpoint=f"{root}/ck", state_partitions=N_RUNS)
    return spark.read.schema(st._R2_OUT).parquet(f"{root}/out")


@query("bounded_pipeline", """
SELECT row_number() OVER (ORDER BY b) - 1 AS micro_batch, n AS n_rows, b AS gen_batch
FROM (SELECT prompt_id // 10 AS b, count(*) AS n FROM fx_rollouts GROUP BY prompt_id // 10) x""", R)
def q_bounded_pipeline(spark, sf):
    """One file per trigger; the generation batches in it are taken one by one, and
    each reports its number and size."""
    root = _fresh(spark, "r3")
    _replay(_rollouts(spark, sf), root)
    st.report_batches(_stream(spark, root), f"{root}/out", checkpoint=f"{root}/ck")
    return spark.read.schema(st._R3_OUT).option("recursiveFileLookup", "true").parquet(f"{root}/out")


_RUNNING_SQL = """
SELECT datasource, round(avg(r), 6) AS mean_reward, count(*) AS count,
       CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed
FROM (SELECT datasource, raw_score - 0.3e0 AS r FROM fx_rollouts) x GROUP BY datasource"""


@query("resume", _RUNNING_SQL, R)
def q_resume(spark, sf):
    """The stream is stopped after the first half of the batches and
    restarted on the same checkpoint after the rest arrived; the restarted
    run processes only the new files."""
    root = _fresh(spark, "r5")
    rows = _rollouts(spark, sf)
    ids = sorted(x[0] for x in rows.select("batch_id").distinct().where("batch_id IS NOT NULL").collect())  # one small row per batch
    first = F.coalesce(F.col("batch_id") < ids[len(ids) // 2], F.lit(False))
    _replay(rows.where(first), root)
    agg = st.running_datasource_stats(_stream(spark, root))
    st.run_to_parquet(agg, "r5", f"{root}/out", mode="complete", checkpoint=f"{root}/ck", state_partitions=2)
    _replay(rows.where(~first), root)
    agg = st.running_datasource_stats(_stream(spark, root))
    st.run_to_parquet(agg, "r5", f"{root}/out", mode="complete", checkpoint=f"{root}/ck", state_partitions=2)
    d = spark.read.parquet(f"{root}/out")
    return d.select("datasource", rnd("mean_reward").alias("mean_reward"), "count", "passed")


@query("resume_state", """
, p AS (SELECT episode, event_id, row_number() OVER (PARTITION BY episode ORDER BY
    CAST('0x' || substr(md5(CAST(11 + episode AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT), event_id) - 1 AS pos
  FROM events, (SELECT unnest([0, 1, 2]) AS episode) e),
c AS (SELECT *, CAST(pos % 4 AS INTEGER) AS rank, pos // 4 AS i, (SELECT count(*) FROM events) // 4 // 25 AS per FROM p)
SELECT episode * per + i // 25 + 1 AS global_step, episode, rank, CAST(i % 25 AS INTEGER) AS slot, event_id FROM c WHERE i // 25 < per""")
def q_resume_state(spark, sf):
    """Three episodes by a run that stops in the middle of the first one, a second
    that stops in the second one, and a third that ends it, each from the state table."""
    e = table(spark, sf, "events").select("event_id")
    per = e.count() // 4 // 25
    root = _fresh(spark, "s12")
    for steps in (per // 2, per, None):
        st.run_steps(e, root, "event_id", replicas=4, per_rank=25, episodes=3, seed=11, max_steps=steps)
    return spark.read.parquet(f"{root}/steps").select("global_step", "episode", "rank", "slot", "event_id")


@query("running_datasource_stats", _RUNNING_SQL, R)
def q_running_datasource_stats(spark, sf):
    root = _fresh(spark, "r6")
    _replay(_rollouts(spark, sf), root)
    agg = st.running_datasource_stats(_stream(spark, root))
    st.run_to_parquet(agg, "r6", f"{root}/out", mode="complete", checkpoint=f"{root}/ck", state_partitions=2)
    d = spark.read.parquet(f"{root}/out")
    return d.select("datasource", rnd("mean_reward").alias("mean_reward"), "count", "passed")


_KL_SQL = """
, s AS (SELECT user_id % 3 AS run, event_id AS step, value / 100.0e0 AS kl, 1 + event_id % 3 AS n FROM events)
SELECT run, round(0.05e0 * exp(sum(ln(1 + least(greatest(kl / 0.3e0 - 1, -0.2e0), 0.2e0) * n / 1000.0e0))), 6) AS kl_coef
FROM s GROUP BY run"""


def _kl_steps(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 3).alias("run"), F.col("event_id").alias("step"),
                    (F.col("value") / 100.0).alias("kl"), (1 + F.col("event_id") % 3).alias("n_steps"))


@query("adaptive_kl", _KL_SQL)
def q_adaptive_kl(spark, sf):
    d = st.adaptive_kl_batch(_kl_steps(spark, sf), 0.05, 0.3, 1000)
    return d.select("run", rnd("kl_coef").alias("kl_coef"))


@query("adaptive_kl_trace", """
, s AS (SELECT user_id % 3 AS run, event_id AS step, value / 100.0e0 AS kl, 1 + event_id % 3 AS n FROM events)
SELECT run, step, round(0.05e0 * exp(sum(ln(1 + least(greatest(kl / 0.3e0 - 1, -0.2e0), 0.2e0) * n / 1000.0e0))
  OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS kl_coef FROM s""")
def q_adaptive_kl_trace(spark, sf):
    d = st.adaptive_kl_trace(_kl_steps(spark, sf), 0.05, 0.3, 1000)
    return d.select("run", "step", rnd("kl_coef").alias("kl_coef"))


@query("adaptive_kl_signed", """
, s AS (SELECT user_id AS run, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    1 + least(greatest(value / 100.0e0 / 0.3e0 - 1, -0.2e0), 0.2e0) * (CASE WHEN event_id % 31 = 0 THEN 10 ELSE 1 + event_id % 13 END) / 2.0e0 AS m FROM events),
fold AS (
  SELECT run, step, k, 0.05e0 * m AS v FROM s WHERE k = 1
  UNION ALL SELECT s.run, s.step, s.k, fold.v * s.m FROM fold JOIN s ON s.run = fold.run AND s.k = fold.k + 1)
SELECT run, step, CAST(sign(v) AS INTEGER) AS sign, CASE WHEN v = 0 THEN NULL ELSE round(ln(abs(v)), 6) END AS log_size FROM fold""", recursive=True)
def q_adaptive_kl_signed(spark, sf):
    """The trace of runs whose factors are below, at and above 0."""
    e = table(spark, sf, "events")
    n = F.when(F.col("event_id") % 31 == 0, 10).otherwise(1 + F.col("event_id") % 13)
    steps = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 100.0).alias("kl"), n.alias("n_steps"))
    d = st.adaptive_kl_trace(steps, 0.05, 0.3, 2)
    size = F.when(F.col("kl_coef") != 0, rnd(F.log(F.abs("kl_coef"))))
    return d.select("run", "step", F.signum("kl_coef").cast("int").alias("sign"), size.alias("log_size"))


@query("fixed_kl", """
SELECT DISTINCT user_id % 3 AS run, 0.05e0 AS kl_coef FROM events""")
def q_fixed_kl(spark, sf):
    return st.adaptive_kl_batch(_kl_steps(spark, sf), 0.05, 0.3, 1000, fixed=True)


@query("adaptive_kl_stream", _KL_SQL)
def q_adaptive_kl_stream(spark, sf):
    """R4 incremental: the last emitted value of each run equals the batch fold."""
    root = _fresh(spark, "r4")
    _arrive(_kl_steps(spark, sf), F.floor(F.col("step") / FILE_STEPS), f"{root}/in")
    s = spark.readStream.schema("run long, step long, kl double, n_steps long").option(
        "maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    out = st.adaptive_kl_stream(s, 0.05, 0.3, 1000)
    st.run_to_parquet(out, "r4", f"{root}/out", checkpoint=f"{root}/ck", state_partitions=3)
    d = spark.read.parquet(f"{root}/out")
    last = d.groupBy("run").agg(F.max_by("kl_coef", "step").alias("kl_coef"))
    return last.select("run", rnd("kl_coef").alias("kl_coef"))


# ------------------------------------------------------------------- blend

_U = "CAST(('0x' || substr(md5('42:' || CAST(t AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0e0"


@query("interleave_datasets", f"""
, src AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS source_idx FROM documents),
rows AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) - 1 AS rw FROM src),
n AS (SELECT source_idx, count(*) AS n FROM src GROUP BY source_idx),
d0 AS (SELECT t, {_U} AS u FROM range(0, CAST((SELECT max(n / CASE source_idx WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END) FROM n) * 6 + 1000 AS BIGINT)) r(t)),
d1 AS (SELECT t, CASE WHEN u < 0.5e0 THEN 0 WHEN u < 0.8e0 THEN 1 ELSE 2 END AS source_idx FROM d0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY t) - 1 AS k FROM d1),
e AS (SELECT max(t) AS t_end FROM d2 JOIN n USING (source_idx) WHERE k = n.n - 1)
SELECT d2.t AS draw, d2.source_idx, rows.doc_id FROM d2 JOIN n USING (source_idx)
  JOIN rows ON rows.source_idx = d2.source_idx AND rows.rw = d2.k % n.n
WHERE d2.t <= (SELECT t_end FROM e)""")
def q_interleave_datasets(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2).alias("source_idx"))
    out = blend.interleave(spark, d, [0.5, 0.3, 0.2], seed=42, order_col="doc_id")
    return out.select("draw", "source_idx", "doc_id")


@query("shared_keys", """
SELECT array_to_string(list_sort(list_intersect(list_intersect(list_intersect(list_intersect(
  a['click'], a['error']), a['purchase']), a['signup']), a['view'])), ',') AS keys
FROM (SELECT map(list(event_type), list(ks)) AS a FROM (
  SELECT event_type, list(DISTINCT CAST(floor(value / 20) AS BIGINT)) AS ks FROM events GROUP BY event_type) x) y""")
def q_shared_keys(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("value") / 20).cast("long").alias("k"))
    d = blend.shared_keys(e, "event_type", "k")
    return d.select(F.array_join("keys", ",").alias("keys"))
