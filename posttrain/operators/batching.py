"""Sharding, micro-batching, packing and balancing (K1-K13, O2-O6, J4, J10,
A18, A19, A22, A24, W10).

Positional operators work on a global position column ``_seq`` (see
:mod:`posttrain.operators.index`). Closed forms are plain column arithmetic.
The sequential planners work on a training step's rows as arrays, which the local
train batch bounds: first fit and greedy are Catalyst folds, largest differencing
is a pandas UDF over Arrow batches of steps.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttrain.operators.index import keyed_prefix_sum, keyed_row_number


# ----------------------------------------------------------- closed forms

def with_count(df: DataFrame, out: str = "__n") -> DataFrame:
    """Attach the row count as a column: reuse it when the position step
    already attached it (``global_index(..., total_out="__n")``), else a
    scalar subquery (one aggregate, evaluated once)."""
    if out in df.columns:
        return df
    return df.withColumn(out, df.agg(F.count(F.lit(1))).scalar())


def rank_shard(df: DataFrame, replicas: int, drop_last: bool = False,
               consumed_samples: int = 0, seq_col: str = "_seq") -> DataFrame:
    """K1: strided split over ``replicas``. Without drop_last the index list is
    padded by wrap-around to a multiple of replicas (a row can appear more
    than once); with it the tail is cut. Each rank skips
    ``consumed_samples // replicas`` of its entries. Adds ``rank`` and
    ``local_idx``. The row count comes from a one-row aggregate, not the driver."""
    added = "__n" not in df.columns
    d = with_count(df)
    n = F.col("__n")
    if drop_last:
        num_samples = F.when(n % replicas != 0, F.ceil((n - replicas) / F.lit(replicas))).otherwise(
            F.ceil(n / F.lit(replicas)))
    else:
        num_samples = F.ceil(n / F.lit(replicas))
    total = (num_samples * replicas).cast("long")
    skip = consumed_samples // replicas
    # position p of the padded list holds row p mod n; row s sits at s, s+n, ...
    d = d.withColumn("__total", total).filter(F.col(seq_col) < F.col("__total"))
    pos = F.explode(F.sequence(F.col(seq_col).cast("long"), (F.col("__total") - 1).cast("long"), n.cast("long")))
    d = d.select("*", pos.alias("__pos"))
    d = d.withColumn("rank", (F.col("__pos") % replicas).cast("int")).withColumn(
        "local_idx", (F.floor(F.col("__pos") / replicas) - skip).cast("long"))
    d = d.filter(F.col("local_idx") >= 0).drop("__pos", "__total")
    return d.drop("__n") if added else d


def ceil_chunks(seq: Column, n_rows: Column, parts: int) -> Column:
    """K2: contiguous chunk of size ceil(n/parts); trailing chunks may be empty."""
    return F.floor(seq / F.ceil(n_rows / F.lit(parts))).cast("long")


def fixed_micro_batches(seq: Column, size: int) -> Column:
    """K3: consecutive blocks of ``size``."""
    return F.floor(seq / F.lit(size)).cast("long")


def drop_ragged_batch(df: DataFrame, size: int, seq_col: str = "_seq") -> DataFrame:
    """Keep only full batches (batch < floor(n/size)); adds ``batch_id``."""
    d = with_count(df).withColumn("batch_id", fixed_micro_batches(F.col(seq_col), size))
    d = d.filter(F.col("batch_id") < F.floor(F.col("__n") / F.lit(size)))
    return d if "__n" in df.columns else d.drop("__n")


def keep_last_n(df: DataFrame, limit: int, seq_col: str = "_seq") -> DataFrame:
    """Evict the oldest rows beyond ``limit`` (limit <= 0 keeps all); each task
    keeps its own newest rows before the shuffle."""
    return df if limit <= 0 else df.orderBy(F.desc(seq_col)).limit(limit)


def hash_order_key(id_col: Column, seed: int) -> Column:
    """Deterministic pseudo-random order key from md5(seed:id) (first
    15 hex digits as a non-negative long)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int, out: str = "_seq") -> DataFrame:
    """Permutation seeded by seed + epoch, as a new global position."""
    from posttrain.operators.index import global_index
    d = df.withColumn("__h", hash_order_key(F.col(id_col), seed + epoch))
    return global_index(d, "__h", tiebreak=[id_col], out=out).drop("__h")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement (hash-ordered top-n; the limit is
    the operator)."""
    return df.withColumn("__h", hash_order_key(F.col(id_col), seed)).orderBy("__h", id_col).limit(n).drop("__h")


def snake_balance(df: DataFrame, lanes: int, len_col: str = "total_length", seq_col: str = "_seq",
                  step_col: str | None = None) -> DataFrame:
    """O2: sort by length desc (ties by input order), cut into chunks of
    ``lanes``, interleave the first half with the reversed second half, and
    zip lanes. Closed form over the rank (survey 2.15); rows beyond the
    shortest lane are dropped as the zip does. Adds ``lane`` and ``slot``."""
    d = df.withColumn("__neg", -F.col(len_col).cast("double"))
    if step_col:
        # a step is one rollout batch: its window is bounded by configuration
        w = Window.partitionBy(step_col)
        d = d.withColumn("__r", F.row_number().over(w.orderBy("__neg", seq_col)) - 1).withColumn(
            "__N", F.count(F.lit(1)).over(w))
    else:
        d = keyed_row_number(d, [], "__neg", tiebreak=[seq_col], out="__r")
        d = d.withColumn("__N", df.agg(F.count(F.lit(1))).scalar())
    E = F.lit(lanes)
    r, N = F.col("__r"), F.col("__N")
    c, p = F.floor(r / E), r % E
    C = F.ceil(N / E)
    h = F.floor(C / 2)
    L = C - h
    z = F.least(E, N - c * E)
    i = L - 1 - (c - h)
    slot = F.when(c < h, 2 * c).when(i < h, 2 * i + 1).otherwise(2 * h)
    lane = F.when(c < h, p).otherwise(z - 1 - p)
    keep_lanes = F.when(N % E == 0, E).otherwise(N % E)
    d = d.withColumn("lane", lane.cast("int")).withColumn("slot", slot.cast("int"))
    return d.filter(F.col("lane") < keep_lanes).drop("__neg", "__r", "__N")


def packed_offsets(df: DataFrame, len_col: str, order_col: str = "_seq", keys: list[str] | None = None) -> DataFrame:
    """Start offset of each sequence in the packed stream (exclusive
    running sum of lengths), without a single-task window."""
    return keyed_prefix_sum(df, keys or [], order_col, len_col, out="offset")


def slice_positions(packed: DataFrame, start: int, end: int, len_col: str = "length") -> DataFrame:
    """Per-token position ids of stream positions [start, end) - one row
    per covered token with its position inside its own sequence."""
    lo = F.greatest(F.col("offset"), F.lit(start))
    hi = F.least(F.col("offset") + F.col(len_col), F.lit(end))
    d = packed.filter(hi > lo)
    return d.select("*", F.explode(F.sequence(lo - F.col("offset"), hi - F.col("offset") - 1)).alias("position_id"))


def pack(tokens_df: DataFrame, sample_col: str, t_col: str, offsets: DataFrame) -> DataFrame:
    """K11 pack: token rows -> flat stream positions (offset + t)."""
    return tokens_df.join(offsets.select(sample_col, "offset"), sample_col).withColumn(
        "stream_pos", F.col("offset") + F.col(t_col)).drop("offset")


def unpack(stream: DataFrame, sample_col: str, t_col: str, value_col: str, width: int | None = None,
           pad_value=0) -> DataFrame:
    """K11 unpack: stream rows -> one padded array per sample (ordered by t)."""
    per = stream.groupBy(sample_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(t_col, value_col))), lambda e: e[value_col]).alias("values"))
    if width is not None:
        per = per.withColumn("values", F.concat("values", F.array_repeat(F.lit(pad_value),
                                                                           F.greatest(F.lit(width) - F.size("values"), F.lit(0)))))
    return per


def inverse_permutation(df: DataFrame, idx_col: str = "index", pos_col: str = "_seq") -> DataFrame:
    """J4 restore_order: rows carried in a permuted order with their original
    index; swap the two columns to get the gather order back."""
    return df.withColumnRenamed(pos_col, "__p").withColumnRenamed(idx_col, pos_col).withColumnRenamed("__p", idx_col)


def plan_offset(local_pos: Column, step: Column, local_batch: int) -> Column:
    """Micro-batch index shifted to its global position."""
    return local_pos + step * F.lit(local_batch)


def regroup_by_prompt(df: DataFrame, prompt_col: str = "prompt", seq_col: str = "_seq") -> DataFrame:
    """Samples of one prompt made adjacent, prompts in first-seen order:
    sort key (min _seq of the prompt, _seq). The window is per prompt
    (bounded by samples per prompt)."""
    first = F.min(seq_col).over(Window.partitionBy(prompt_col))
    return df.withColumn("group_order", first)


def collate_info(df: DataFrame, batch_col: str, cols: list[str], seq_col: str = "_seq",
                 ds_col: str = "datasource") -> DataFrame:
    """Rows -> one row per batch with ordered lists; datasource defaults
    to 'default'. The collected list is bounded by the batch size."""
    d = df.withColumn(ds_col, F.coalesce(F.col(ds_col), F.lit("default"))) if ds_col in df.columns else df
    s = F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("__s"), *[F.col(c) for c in cols])))
    per = d.groupBy(batch_col).agg(s.alias("__a"))
    def field(c):
        return F.transform("__a", lambda e: e[c]).alias(c)
    return per.select(batch_col, *[field(c) for c in cols])


#: Variant types by their kind; the precision of a decimal and the fields of an object do not count.
_KINDS = {"BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "STRING": "str", "BOOLEAN": "bool",
          "VOID": "null", "ARRAY": "list", "OBJECT": "map"}


def collate_typed_info(df: DataFrame, batch_col: str, order_col: str, info_col: str) -> DataFrame:
    """A22 over info objects (JSON text whose values may have any type): one row per
    batch and key of the batch's first row, ``key, kind, numbers, texts, error``.

    ``numbers`` holds the values in row order where all of them are numbers or
    booleans, ``texts`` their JSON text otherwise. The values of a key must have one
    kind, that of the first row (booleans count as integers behind an integer), and
    every row must have the key; else ``error`` says so and there are no values. Keys
    that the first row lacks are left out. Malformed or null info has no keys. Rows of a
    batch differ in ``order_col``. One grouping by batch and key, one by batch; both
    are bounded by the batch."""
    rows = df.select(F.col(batch_col).alias("__b"), F.col(order_col).alias("__o"), F.try_parse_json(info_col).alias("__v"))
    entries = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).where(F.col("key").isNotNull())
    kinds = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    kind = kinds[F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)]
    entry = F.struct(F.col("__o").alias("o"), kind.alias("kind"), F.to_json("value").alias("text"),
                     F.expr("try_variant_get(value, '$', 'double')").alias("number"))
    per_key = entries.select("__b", "key", entry.alias("e")).groupBy("__b", "key").agg(F.array_sort(F.collect_list("e")).alias("es"))
    per_batch = rows.groupBy("__b").agg(F.count("*").alias("n"), F.min("__o").alias("first"))
    d = per_key.join(per_batch, "__b").where(F.col("es")[0]["o"].eqNullSafe(F.col("first"))).withColumn("kind", F.col("es")[0]["kind"])
    fits = lambda e: (e["kind"] == F.col("kind")) | ((F.col("kind") == "int") & (e["kind"] == "bool"))
    found = F.array_join(F.array_sort(F.array_distinct(F.transform("es", lambda e: e["kind"]))), ", ")
    error = (F.when(F.size("es") < F.col("n"), F.concat(F.lit("missing in "), (F.col("n") - F.size("es")).cast("string"), F.lit(" rows")))
             .when(~F.forall("es", fits), F.concat(F.lit("inconsistent types: "), found)))
    numeric = F.col("kind").isin("int", "float", "bool")
    d = d.withColumn("error", error)
    return d.select(F.col("__b").alias(batch_col), "key", "kind",
                    F.when(F.col("error").isNull() & numeric, F.transform("es", lambda e: e["number"])).alias("numbers"),
                    F.when(F.col("error").isNull() & ~numeric, F.transform("es", lambda e: e["text"])).alias("texts"), "error")


def merge_batches(frames: list[DataFrame], pad_cols: dict[str, object], batch_col: str = "batch_id") -> DataFrame:
    """A19 over rows: concatenate batches (columns unioned, missing ones null), right
    pad array columns to the merged batch's longest, each with its own value."""
    from posttrain.operators.sft import pad_sequences
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return pad_sequences(out, pad_cols, batch_col)


def merge_experiences(batches: DataFrame, into_col: str, order_col: str, pad: dict[str, object] | None = None,
                      lists: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> DataFrame:
    """A19 over whole batches: one row per ``into_col`` from the batches (rows) that go
    into it, in ``order_col`` order.

    ``pad``: columns of sequences (arrays of arrays) with the value each one is padded
    with on the right, to the longest sequence of the merged batch. ``lists``: appended.
    ``maps`` (of lists): the union of the keys; lists of a key that several batches have
    are appended in batch order, so nothing is lost by a clash. A null column of a batch
    adds nothing; a merged map has its keys in order; batches with equal orders are taken
    by their content. A merged batch is bounded by
    configuration; the work is one grouping."""
    pad = pad or {}
    kinds = {c: batches.schema[c].dataType for c in pad}
    # maps have no order, their entries do
    fields = [*pad, *lists, *(F.map_entries(c).alias(c) for c in maps)]
    per = batches.groupBy(into_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("__o"), F.struct(*fields).alias("b")))).alias("__a"))

    def column(c: str) -> Column:
        return F.filter(F.transform("__a", lambda e: e["b"][c]), lambda x: x.isNotNull())

    def padded(c: str, value: object) -> Column:
        rows = F.flatten(column(c))
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(value), width - F.size(r)))).cast(kinds[c]).alias(c)

    def merged(c: str) -> Column:
        entries = F.flatten(column(c))
        keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
        full = F.filter(entries, lambda e: e["value"].isNotNull())
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.flatten(F.transform(F.filter(full, lambda e: e["key"] == k), lambda e: e["value"])))).alias(c)

    out = [*(padded(c, v) for c, v in pad.items()), *(F.flatten(column(c)).alias(c) for c in lists), *(merged(c) for c in maps)]
    return per.select(into_col, *out)


def row_explode(batches: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """P25: batch arrays to rows: ``keys``, ``pos`` and one value of each of ``cols``. A
    batch whose arrays differ in length is quarantined: one row with null values and
    an ``error`` that names the lengths. A null array has length 0; an empty batch has
    no rows."""
    size = {c: F.coalesce(F.size(c), F.lit(0)) for c in cols}
    same = reduce(lambda a, b: a & b, (size[c] == size[cols[0]] for c in cols))
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), size[c].cast("string")) for c in cols))
    none = F.struct(*(F.element_at(F.col(c), -1).alias(c) for c in cols))
    item = F.arrays_zip(*(F.coalesce(F.col(c), F.array().cast(batches.schema[c].dataType)).alias(c) for c in cols))
    refused = F.array(F.when(F.lit(False), none))
    d = batches.select(*keys, F.when(~same, told).alias("error"), F.posexplode(F.when(same, item).otherwise(refused)).alias("pos", "__e"))
    return d.select(*keys, F.when(F.col("error").isNull(), F.col("pos")).alias("pos"), *(F.col("__e")[c].alias(c) for c in cols), "error")


# ------------------------------------------------------ sequential planners

def first_fit_expr(lengths: Column, budget: int) -> Column:
    """K4 as a Catalyst fold over an ordered length array: the array of bin
    loads (its size is the bin count). No Python; O(items x bins)."""
    b = F.lit(int(budget))

    def place(bins, x):
        pos = F.array_position(F.transform(bins, lambda load: load + x <= b), True)
        return F.when(pos == 0, F.concat(bins, F.array(x))).otherwise(
            F.transform(bins, lambda load, i: F.when(i + 1 == pos, load + x).otherwise(load)))

    return F.aggregate(lengths.cast("array<long>"), F.array().cast("array<long>"), place)


def least_loaded_expr(lengths: Column, k: int, equal_size: bool = False) -> Column:
    """K6 as a fold: each item in arrival order to the lightest set (lowest
    index on ties); returns the set index of every item."""
    bias = F.aggregate(lengths.cast("array<long>"), F.lit(0).cast("long"), lambda a, x: a + x) + 1 \
        if equal_size else F.lit(0).cast("long")
    init = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("sums"), F.array().cast("array<int>").alias("parts"))

    def place(st, x):
        j = F.array_position(st["sums"], F.array_min(st["sums"]))
        sums = F.transform(st["sums"], lambda v, i: F.when(i + 1 == j, v + x + bias).otherwise(v))
        return F.struct(sums.alias("sums"), F.concat(st["parts"], F.array((j - 1).cast("int"))).alias("parts"))

    return F.aggregate(lengths.cast("array<long>"), init, place)["parts"]


def difference_sets(lengths: np.ndarray, k: int, equal_size: bool = False) -> np.ndarray:
    """K5: the set of each item under the largest differencing method (Karmarkar
    and Karp, 1982, for ``k`` sets; with ``equal_size`` its balanced form, which
    starts from groups of ``k`` items of similar length).

    A partial solution is a vector of ``k`` totals with, beside it, the set that each
    item of the solution is in; the two solutions whose totals differ most are laid
    over each other, the fullest set of one on the emptiest of the other. Of equal
    differences the older solution is taken. With fewer than ``k`` items every item is
    a set; otherwise no set is empty, and with ``equal_size`` set sizes differ by one
    at most. Sets are numbered by their first item."""
    n = len(lengths)
    k = min(k, n)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    step = k if equal_size else 1
    waiting = []
    for age, at in enumerate(range(0, n, step)):
        items = order[at:at + step]
        totals = np.zeros(k, np.int64)
        totals[:len(items)] = lengths[items]
        waiting.append((int(totals.min() - totals.max()), age, totals, items, np.arange(len(items))))
    heapq.heapify(waiting)
    age = n
    while len(waiting) > 1:
        _, _, t1, i1, s1 = heapq.heappop(waiting)
        _, _, t2, i2, s2 = heapq.heappop(waiting)
        onto = np.empty(k, np.int64)  # set of the second that goes on each set of the first
        onto[np.argsort(t2, kind="stable")] = np.argsort(-t1, kind="stable")
        totals = t1.copy()
        totals[onto] += t2
        age += 1
        heapq.heappush(waiting, (int(totals.min() - totals.max()), age, totals,
                                 np.concatenate([i1, i2]), np.concatenate([s1, onto[s2]])))
    _, _, _, items, sets = waiting[0]
    out = np.empty(n, np.int64)
    out[items] = sets
    size = np.bincount(out, minlength=k)
    while size.min() == 0:  # only among items of length 0
        out[np.flatnonzero(out == size.argmax())[-1]] = size.argmin()
        size = np.bincount(out, minlength=k)
    first = np.unique(out, return_index=True)[1]
    number = np.empty(k, np.int64)
    number[np.argsort(first)] = np.arange(k)
    return number[out]


def difference_sets_column(lengths: Column, k: Column, equal_size: bool = False) -> Column:
    """:func:`difference_sets` of a length array, per row (Arrow batches): the set of
    each item, and the number of items in that set."""
    @F.pandas_udf("part array<int>, size array<int>")
    def sets(lens: pd.Series, ks: pd.Series) -> pd.DataFrame:
        part = [difference_sets(np.asarray(x, np.int64), int(n), equal_size).astype(np.int32) for x, n in zip(lens, ks, strict=True)]
        return pd.DataFrame({"part": part, "size": [np.bincount(p)[p].astype(np.int32) if len(p) else p for p in part]})
    return sets(lengths, k)


def step_lists(df: DataFrame, keys: list[str], seq_col: str, len_col: str, id_col: str) -> DataFrame:
    """``keys, lens, ids``: each step's rows in order, as arrays (a step is bounded by
    the local batch). The partition count is stated, about one per 32 MB of input
    and one per core, because AQE would put this small shuffle, and with it the
    planning, into one task."""
    from posttrain.operators.sizing import input_bytes
    n = max(df.sparkSession.sparkContext.defaultParallelism, input_bytes(df) // (32 * 1024 * 1024))
    rows = df.select(*keys, seq_col, len_col, id_col).repartition(n, *keys)
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(seq_col, F.col(len_col).cast("long").alias("l"), id_col))).alias("__a"))
    return per.select(*keys, F.transform("__a", lambda e: e["l"]).alias("lens"), F.transform("__a", lambda e: e[id_col]).alias("ids"))


def _planned(lists: DataFrame, keys: list[str], sets: Column, *carry: str) -> DataFrame:
    """One row per item: keys, ``part``, ``id``, position, and (of sets that come with
    it) the size of its set."""
    d = lists.withColumn("__p", sets)
    sized = dict(d.dtypes)["__p"].startswith("struct")
    columns = [F.col("__p.part").alias("part"), F.col("__p.size").alias("size")] if sized else [F.col("__p").alias("part")]
    item = F.arrays_zip(*columns, F.col("ids").alias("id"), F.sequence(F.lit(0), F.size("ids") - 1).alias("pos"))
    return d.select(*keys, *carry, F.size("ids").alias("n"), F.inline(item))


def micro_batch_plan(df: DataFrame, local_batch: int, max_tokens: int, ring: int = 1, tp: int = 1,
                     seq_col: str = "_seq", len_col: str = "total_length", id_col: str = "sample_id",
                     rank_col: str | None = None) -> DataFrame:
    """K7: per train step (``local_batch`` consecutive rows of each rank):
    number of micro-batches by first fit under ``max_tokens*ring*tp`` for
    every rank, the max of those counts across ranks, balanced sets of
    each rank's step into that many micro-batches (largest differencing; a rank
    with fewer rows than that has one for each row), loss_scale = |set|/|step| and
    optimizer_step = 1 on the last micro-batch. A row of lists is one rank's step;
    the counts meet over a step's ranks."""
    rk = rank_col or "__rank"
    d = df.withColumn("step", F.floor(F.col(seq_col) / F.lit(local_batch)).cast("long"))
    if rank_col is None:
        d = d.withColumn(rk, F.lit(0).cast("long"))
    lists = step_lists(d, ["step", rk], seq_col, len_col, id_col)
    bins = F.size(first_fit_expr(F.col("lens"), max_tokens * ring * tp))
    lists = lists.withColumn("n_micro", F.max(bins).over(Window.partitionBy("step")))
    out = _planned(lists, ["step", rk], difference_sets_column(F.col("lens"), F.col("n_micro")), "n_micro")
    last = F.least("n_micro", "n") - 1
    return out.select("step", F.col("part").alias("micro_batch"), F.col("id").alias(id_col), F.col("pos").alias("local_pos"),
                      (F.col("size") / F.col("n")).alias("loss_scale"), (F.col("part") == last).cast("int").alias("optimizer_step"),
                      "n_micro", *([rank_col] if rank_col else []))


def rollout_batch_plan(df: DataFrame, actors: int, max_tokens: int, group_col: str = "rollout_step",
                       seq_col: str = "_seq", len_col: str = "total_length", id_col: str = "sample_id",
                       ring: int = 1, tp: int = 1) -> DataFrame:
    """K8: per rollout step: first-fit count, rounded down to a multiple of
    the actor count but at least ``actors``, then balanced sets, that many
    batches (floor rounding means a batch can exceed the budget; a step with fewer
    rows has one for each row)."""
    lists = step_lists(df, [group_col], seq_col, len_col, id_col)
    bins = F.size(first_fit_expr(F.col("lens"), max_tokens * ring * tp))
    count = F.greatest(F.floor(bins / F.lit(actors)) * actors, F.lit(actors)).cast("int")
    # one row a step; the window keeps the fold out of the Python call's arguments
    lists = lists.withColumn("n_batches", F.max(count).over(Window.partitionBy(group_col)))
    out = _planned(lists, [group_col], difference_sets_column(F.col("lens"), F.col("n_batches")), "n_batches")
    return out.select(group_col, F.col("part").alias("batch"), F.col("id").alias(id_col), "n_batches")


def first_fit_count(df: DataFrame, budget: int, group_col: str, seq_col: str = "_seq",
                    len_col: str = "total_length") -> DataFrame:
    """K4 as a query: bins per group (a Catalyst fold, no Python)."""
    per = df.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(seq_col, len_col))).alias("__a"))
    bins = first_fit_expr(F.transform("__a", lambda e: e[len_col]), budget)
    return per.select(group_col, F.size(bins).alias("n_bins"), F.array_max(bins).alias("max_bin"))


def balanced_partitions(df: DataFrame, k: int, group_col: str, seq_col: str = "_seq",
                        len_col: str = "total_length", id_col: str = "sample_id", equal_size: bool = False,
                        method: str = "kk") -> DataFrame:
    """K5 / K6 as a query: set of every row, per group. The greedy method is a
    Catalyst fold; largest differencing runs per Arrow batch of groups."""
    lists = step_lists(df, [group_col], seq_col, len_col, id_col)
    sets = difference_sets_column(F.col("lens"), F.lit(k), equal_size) if method == "kk" \
        else least_loaded_expr(F.col("lens"), k, equal_size)
    return _planned(lists, [group_col], sets).select(group_col, "part", F.col("id").alias(id_col))
