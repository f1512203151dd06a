"""Incremental rollout loop on Structured Streaming.

Rollout batches arrive as files; ``maxFilesPerTrigger`` bounds each
micro-batch (back-pressure) and ``availableNow`` ends the run when the input
is drained. State lives in the streaming state store under the query's
``checkpointLocation`` (in the shared checkpoint folder), so a restarted query
resumes from its last committed batch.

Per-run state (pending group ids, a FIFO buffer, the KL coefficient) is keyed
by ``run``: one key is one sequential training run, so it is sequential by
definition; many runs shard across tasks.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from posttrain.operators.batching import epoch_shuffle, rank_shard
from posttrain.session import checkpoint_dir


def rollout_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The bounded pipeline - each trigger takes at most
    ``max_files_per_trigger`` new rollout files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(path))


_R3_OUT = "n_rows long, gen_batch long, micro_batch long"


def report_batches(stream: DataFrame, out_path: str, checkpoint: str, batch_col: str = "batch_id") -> None:
    """R3, the consumer: runs ``stream`` to the end of the available input and reports
    each generation batch, in order (null last): its rows and its number, which runs on
    over triggers and restarts. The generation batches that one trigger takes (each as a
    whole) are counted together and numbered one by one, so how many of them arrive
    together changes nothing. A trigger reports into a folder of its own, so one that is
    run again replaces its rows."""
    spark = stream.sparkSession
    following: dict[int, int] = {}  # trigger: number of its first generation batch

    def reports(*triggers: int) -> list[str]:
        return [f"{out_path}/b{t:09d}" for t in triggers]

    def reported(*triggers: int) -> int:
        return spark.read.schema(_R3_OUT).parquet(*reports(*triggers)).count() if triggers else 0

    def sink(batch: DataFrame, trigger: int) -> None:
        first = following.pop(trigger) if trigger in following else reported(*range(trigger))  # the latter after a restart
        # one row for each generation batch of the trigger
        sizes = batch.groupBy(F.col(batch_col).alias("gen_batch")).agg(F.count(F.lit(1)).alias("n_rows"))
        number = F.row_number().over(Window.orderBy(F.col("gen_batch").asc_nulls_last())) - 1 + F.lit(first)
        sizes.select("n_rows", "gen_batch", number.cast("long").alias("micro_batch")).write.mode("overwrite").parquet(*reports(trigger))
        following[trigger + 1] = first + reported(trigger)

    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # counts only, summed before the shuffle
    try:
        q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    q.awaitTermination()


# --------------------------------------------------------------- R1 filter

_R1_OUT = "run long, emit_step long, group_id long, n_seen long, n_kept long"
_R1_STATE = "pending array<long>, seen long, kept long, emitted long"


def filter_accumulate(stream: DataFrame, n_samples: int, batch_groups: int,
                      reward_range: tuple[float, float] = (0.0, 1.0), run_col: str = "run",
                      group_col: str = "group_id", batch_col: str = "batch_id",
                      score_col: str = "score") -> DataFrame:
    """R1 (+P17, A12): within each generation batch, a group is admitted when it is
    complete and lo + 1e-6 < mean score < hi - 1e-6; admitted groups
    accumulate per run until ``batch_groups`` are pending, then exactly that
    many (in arrival order) are emitted, the surplus is discarded and the
    counters reset. The generation batches of one micro-batch are taken one by one,
    so how many of them arrive together (each as a whole) changes nothing. The state
    holds only group ids and two counters; admission works on the run's rows of one
    micro-batch."""
    lo, hi = reward_range

    def step(key, pdfs, state):
        if state.exists:
            pending, seen, kept, emitted = state.get
            pending = list(pending)
        else:
            pending, seen, kept, emitted = [], 0, 0, 0
        rows = pd.concat(list(pdfs), ignore_index=True)
        g = rows.groupby([batch_col, group_col], sort=True)[score_col].agg(["count", "mean"]).reset_index()
        out = []
        for _, b in g.groupby(batch_col, sort=True):
            seen += int(b["count"].sum())
            adm = b[(b["count"] == n_samples) & (b["mean"] > lo + 1e-6) & (b["mean"] < hi - 1e-6)]
            kept += int(adm["count"].sum())
            pending += [int(x) for x in adm[group_col]]
            if len(pending) >= batch_groups:
                out += [(key[0], emitted, gid, seen, kept) for gid in pending[:batch_groups]]
                pending, seen, kept, emitted = [], 0, 0, emitted + 1  # surplus discarded
        state.update((pending, seen, kept, emitted))
        yield pd.DataFrame(out, columns=["run", "emit_step", "group_id", "n_seen", "n_kept"])

    rows = stream.select(run_col, batch_col, group_col, score_col)
    return rows.groupBy(run_col).applyInPandasWithState(step, _R1_OUT, _R1_STATE, "append",
                                                        GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------- R2 buffer

_R2_OUT = "run long, step long, sample_id long"
_R2_STATE = "items array<long>, appends long, step long"


def fifo_buffer(stream: DataFrame, limit: int, appends_per_step: int, run_col: str = "run",
                id_col: str = "sample_id", batch_col: str = "batch_id") -> DataFrame:
    """R2 (+O6): each generation batch appends its samples; over ``limit`` the
    oldest are evicted; after ``appends_per_step`` appends a training step
    consumes the buffer (emitted) and it is cleared. The generation batches of one
    micro-batch are taken one by one."""
    def step(key, pdfs, state):
        items, appends, stp = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values([batch_col, id_col])
        out = []
        for _, b in batch.groupby(batch_col, sort=True, dropna=False):
            items += [int(x) for x in b[id_col]]
            if limit > 0 and len(items) > limit:
                items = items[len(items) - limit:]
            appends += 1
            if appends >= appends_per_step:
                out += [(key[0], stp, x) for x in items]
                items, appends, stp = [], 0, stp + 1
        state.update((items, appends, stp))
        yield pd.DataFrame(out, columns=["run", "step", "sample_id"])

    rows = stream.select(run_col, batch_col, id_col)
    return rows.groupBy(run_col).applyInPandasWithState(step, _R2_OUT, _R2_STATE, "append",
                                                        GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------ R4 KL control

def kl_multiplier(kl: Column, n: Column, target: float, horizon: int) -> Column:
    """One step's factor: 1 + clip(kl/target - 1, -0.2, 0.2) * n / horizon."""
    err = F.least(F.greatest(kl / F.lit(float(target)) - 1, F.lit(-0.2)), F.lit(0.2))
    return F.lit(1.0) + err * n / F.lit(float(horizon))


def adaptive_kl_batch(steps: DataFrame, init: float, target: float, horizon: int, run_col: str = "run",
                      step_col: str = "step", kl_col: str = "kl", n_col: str = "n_steps",
                      fixed: bool = False) -> DataFrame:
    """R4 over a finished log: per run, v = init * prod over steps of
    (1 + clip(kl/target - 1, -0.2, 0.2) * n/horizon). The product does not
    depend on the step order, so it is a plain aggregate (partial per
    partition, no per-run list): |v| = init * exp(sum(ln|m|)), the sign from
    the count of negative factors (a factor <= 0 appears only when
    n >= 5 * horizon), 0 when any factor is 0. The fixed controller keeps ``init``."""
    m = kl_multiplier(F.col(kl_col), F.col(n_col), target, horizon)
    if fixed:
        return steps.select(run_col).distinct().select(run_col, F.lit(float(init)).alias("kl_coef"))
    per = steps.groupBy(run_col).agg(
        F.sum(F.log(F.abs(F.nullif(m, F.lit(0.0))))).alias("__ls"),
        F.sum(F.when(m < 0, 1).otherwise(0)).alias("__neg"),
        F.max(F.when(m == 0, 1).otherwise(0)).alias("__zero"))
    mag = F.lit(float(init)) * F.exp(F.coalesce(F.col("__ls"), F.lit(0.0)))
    sign = F.when(F.col("__neg") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return per.select(run_col, F.when(F.col("__zero") == 1, F.lit(0.0)).otherwise(sign * mag).alias("kl_coef"))


def adaptive_kl_trace(steps: DataFrame, init: float, target: float, horizon: int, run_col: str = "run",
                      step_col: str = "step", kl_col: str = "kl", n_col: str = "n_steps") -> DataFrame:
    """R4 per step: the coefficient after each step. A product of factors of any
    sign is an associative scan of (log of its size, number of negative factors, number
    of zeros): three running sums in one bucketed plan, so a long run is not one task.
    From a factor of 0 on the coefficient is 0."""
    from posttrain.operators.index import keyed_prefix_sums
    m = kl_multiplier(F.col(kl_col), F.col(n_col), target, horizon)
    d = (steps.withColumn("__m", m).withColumn("__lm", F.when(F.col("__m") != 0, F.log(F.abs("__m"))).otherwise(0.0))
         .withColumn("__neg", (F.col("__m") < 0).cast("long")).withColumn("__zero", (F.col("__m") == 0).cast("long")))
    d = keyed_prefix_sums(d, [run_col], step_col, {"__plm": "__lm", "__pneg": "__neg", "__pzero": "__zero"}, bounds=steps.select(step_col))
    size = F.lit(float(init)) * F.exp(F.col("__plm") + F.col("__lm"))
    sign = F.when((F.col("__pneg") + F.col("__neg")) % 2 == 1, -1.0).otherwise(1.0)
    coef = F.when(F.col("__pzero") + F.col("__zero") > 0, 0.0).otherwise(sign * size)
    return d.withColumn("kl_coef", coef).drop("__m", "__lm", "__neg", "__zero", "__plm", "__pneg", "__pzero")


_R4_STATE = "value double"


def adaptive_kl_stream(stream: DataFrame, init: float, target: float, horizon: int, run_col: str = "run",
                       step_col: str = "step", kl_col: str = "kl", n_col: str = "n_steps") -> DataFrame:
    """R4 incremental: the coefficient is per-run state updated by every
    step's KL in step order; each step emits the value after its update."""
    def step(key, pdfs, state):
        v = state.get[0] if state.exists else float(init)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(step_col)
        out = []
        for s, kl, n in zip(batch[step_col], batch[kl_col], batch[n_col]):
            err = min(max(kl / target - 1.0, -0.2), 0.2)
            v *= 1.0 + err * n / horizon
            out.append((key[0], int(s), v))
        state.update((v,))
        yield pd.DataFrame(out, columns=[run_col, step_col, "kl_coef"])

    return stream.select(run_col, step_col, kl_col, n_col).groupBy(run_col).applyInPandasWithState(
        step, f"{run_col} long, {step_col} long, kl_coef double", _R4_STATE, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------- R6 running stats

def running_datasource_stats(stream: DataFrame, ds_col: str = "datasource", reward_col: str = "reward") -> DataFrame:
    """R6 (= A4 on a stream): streaming aggregate, complete/update mode."""
    return stream.groupBy(ds_col).agg(F.avg(reward_col).alias("mean_reward"), F.count(F.lit(1)).alias("count"),
                                      F.sum(F.when(F.col(reward_col) > 0, 1).otherwise(0)).cast("long").alias("passed"))


# ------------------------------------------------------- S12 resume state

STATE_SCHEMA = "global_step long, episode int, offset long"


def load_state(spark: SparkSession, path: str) -> tuple[int, int, int, int]:
    """``(global_step, episode, offset, batch_id)`` of the last commit under
    ``path``; zeros and batch -1 when nothing was committed."""
    try:
        rows = spark.read.schema(STATE_SCHEMA + ", batch_id long").parquet(f"{path}/state")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, 0, 0, -1
    last = rows.orderBy(F.desc("batch_id")).first()  # one row a commit
    return (0, 0, 0, -1) if last is None else (last["global_step"], last["episode"], last["offset"], last["batch_id"])


def run_steps(samples: DataFrame, path: str, id_col: str, replicas: int, per_rank: int, episodes: int, seed: int = 0,
              max_steps: int | None = None) -> bool:
    """S12 with K1 and O4: the loader's part of a training run, from the committed state
    on: each episode is a permutation seeded by ``seed + episode``, dealt to ``replicas``
    ranks, ``per_rank`` samples a rank and step, full steps only. ``max_steps`` ends the
    run early, in the middle of an episode too.

    Rows ``global_step, episode, rank, slot, <id>`` go to ``path/steps``; then the state
    (last step, episode, samples of the episode that are consumed) is committed with the
    same batch id. A run that dies between the two is done again by the next one, which
    overwrites its rows, so the table is that of one uninterrupted run. Returns whether
    all episodes are done."""
    spark = samples.sparkSession
    step, episode, offset, batch = load_state(spark, path)
    per_step = replicas * per_rank
    per_episode = samples.count() // replicas // per_rank
    left = per_episode * episodes if max_steps is None else max_steps
    out = None
    while episode < episodes and per_episode and left > 0:
        done = offset // per_step
        take = min(left, per_episode - done)
        rows = rank_shard(epoch_shuffle(samples.select(id_col), id_col, seed, episode), replicas, drop_last=True, consumed_samples=offset)
        rows = rows.withColumn("__s", F.floor(F.col("local_idx") / per_rank).cast("long")).where(F.col("__s") < take)
        rows = rows.select((F.col("__s") + step + 1).alias("global_step"), F.lit(episode).alias("episode"), "rank",
                           (F.col("local_idx") % per_rank).cast("int").alias("slot"), id_col)
        out = rows if out is None else out.unionByName(rows)
        step, left, offset = step + take, left - take, (done + take) * per_step
        if done + take == per_episode:
            episode, offset = episode + 1, 0
    if out is not None:
        out.write.mode("overwrite").parquet(f"{path}/steps/batch_id={batch + 1}")
        state = spark.createDataFrame([(step, episode, offset)], STATE_SCHEMA)
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch_id={batch + 1}")
    return episode >= episodes or not per_episode


# ------------------------------------------------------------------ runner

def run_to_parquet(df: DataFrame, name: str, out_path: str, mode: str = "append",
                   checkpoint: str | None = None,
                   state_partitions: int | None = None) -> None:
    """Run a streaming query to the end of the available input
    (``availableNow``). Append-mode results go to a Parquet sink; complete-
    mode aggregates are rewritten per batch with ``foreachBatch`` (a small
    table). Restarting with the same checkpoint resumes where it stopped.

    ``state_partitions``: the number of state-store partitions, fixed in the
    checkpoint at the first start (default: the cluster's parallelism, which
    suits a handful of run keys; many runs want more)."""
    spark = df.sparkSession
    ck = checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    n = state_partitions or spark.sparkContext.defaultParallelism
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        _run(df, ck, out_path, mode)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)


def _run(df: DataFrame, ck: str, out_path: str, mode: str) -> None:
    w = df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out_path).start()
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_path)
        q = w.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()  # raises if the query failed
