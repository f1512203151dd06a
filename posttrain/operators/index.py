"""Positions without a single-task window (K0 global_index and its keyed form).

A position column (``_seq``) is what the reference gets for free from list
order. ``Window.orderBy`` without ``partitionBy`` would move every row into one
task, and ``partitionBy(key)`` puts a hot key (say a third of all rows) in one
task. Both are avoided here, in one plan without a job while it is built:

1. boundaries between buckets come from a sample of the order key (with its tiebreak
   columns, so equal values are split too). Keys are chosen by a hash threshold, so
   each task sends its share of the sample only. Up to ``COARSE`` buckets are cut at
   once from a sample of bounded size; more are cut in two levels: each coarse bucket
   draws its own boundaries from the keys that fall into it, in parallel;
2. rows are numbered inside each ``(key, bucket)`` with ``row_number`` - a hot key
   is spread over all buckets;
3. rows per ``(key, bucket)`` are counted (map-side combined), the counts are
   prefix-summed per key over at most ``buckets`` rows, and the offset is added.

The number of buckets follows the bytes that the plan reads, without a bound. Keys
and order columns may be of any orderable type; nulls come first and null keys are
keys like others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttrain.operators.sizing import input_bytes

TARGET_BUCKET_BYTES = 256 * 1024 * 1024
SAMPLES_PER_BUCKET = 24
#: Buckets that are cut in one step, from one task's sample.
COARSE = 1024


def default_buckets(df: DataFrame) -> int:
    """About one bucket per ``TARGET_BUCKET_BYTES`` of input, and at least one for
    each core, so a hot key's rows are split into pieces a task can sort."""
    return max(df.sparkSession.sparkContext.defaultParallelism, input_bytes(df) // TARGET_BUCKET_BYTES)


def _sample(source: DataFrame, order: list[str], size: int) -> DataFrame:
    """About ``size`` distinct order keys ``k``, by a threshold on their hash that
    follows the row count; all of them where there are fewer rows."""
    key = F.struct(*order)
    n = source.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    share = F.least(F.lit(float(size)) / n, F.lit(1.0)) * float(1 << 30)
    return source.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share).distinct()


def _cuts(buckets: int) -> Column:
    """Boundaries between ``buckets`` equal shares of the keys ``k`` of a group."""
    keys = F.sort_array(F.collect_list("k"))
    return F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)),
                       lambda i: F.get(keys, F.floor(i * F.size(keys) / F.lit(buckets)).cast("int")))


def _search(df: DataFrame, cuts: str, buckets: int, out: str) -> DataFrame:
    """``out``: the number of ``cuts`` (ascending, at most ``buckets - 1``) up to the key
    ``__at``; a binary search of plain comparisons, which stays in generated code."""
    df = df.withColumn(out, F.lit(0))
    for j in reversed(range((buckets - 1).bit_length())):
        up = F.expr(f"if(get({cuts}, {out} + {(1 << j) - 1}) <= __at, {1 << j}, 0)")
        df = df.withColumn(out, F.col(out) + up)
    return df


def range_bucket(df: DataFrame, order: str | Sequence[str], buckets: int | None = None,
                 bounds: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__bucket``: a monotone bucket number of the order columns.
    ``bounds``: a narrower frame to sample instead of ``df`` (it has a leading part
    of the order columns)."""
    order = [order] if isinstance(order, str) else list(order)
    source = bounds if bounds is not None else df
    if bounds is not None:
        order = [c for c in order if c in bounds.columns]
    buckets = buckets or default_buckets(source)
    if buckets <= 1:
        return df.withColumn("__bucket", F.lit(0))
    coarse = min(buckets, COARSE)
    cuts = _sample(source, order, coarse * SAMPLES_PER_BUCKET).agg(_cuts(coarse).alias("cuts")).scalar()

    def placed(rows: DataFrame) -> DataFrame:
        return _search(rows.withColumn("__cuts", cuts), "__cuts", coarse, "__bucket").drop("__cuts")

    out = placed(df.withColumn("__at", F.struct(*order)))
    if buckets > coarse:
        fine = -(-buckets // coarse)
        inner = (placed(_sample(source, order, buckets * SAMPLES_PER_BUCKET).withColumn("__at", F.col("k")))
                 .groupBy("__bucket").agg(_cuts(fine).alias("__fine")))
        # one key a bucket, as many as the table of offsets has rows
        out = _search(out.join(F.broadcast(inner), "__bucket", "left"), "__fine", fine, "__part")
        out = out.withColumn("__bucket", F.col("__bucket") * fine + F.col("__part")).drop("__fine", "__part")
    return out.drop("__at")


def _with_offsets(numbered: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Join on key and bucket; null keys match."""
    named = offsets.select(*(F.col(c).alias(f"__o_{c}") for c in [*keys, "__bucket"]),
                           *(c for c in offsets.columns if c not in keys and c != "__bucket"))
    if not keys:
        named = F.broadcast(named)  # one row per bucket
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in [*keys, "__bucket"]))
    return numbered.join(named, same).drop(*(f"__o_{c}" for c in [*keys, "__bucket"]))


def keyed_row_number(df: DataFrame, keys: Sequence[str], order_col: str,
                     tiebreak: Sequence[str] = (), out: str = "rn",
                     buckets: int | None = None, bounds: DataFrame | None = None,
                     total_out: str | None = None) -> DataFrame:
    """0-based ``row_number() over (partition by keys order by order_col, tiebreak)``
    computed without putting a hot key into a single task. ``bounds``: a frame
    with the order columns to sample the bucket boundaries from (default ``df``).
    ``total_out``: also attach the row count of the key (of the whole frame
    when there are no keys), read off the small counts table - no extra pass."""
    keys, order = list(keys), [order_col, *tiebreak]
    with_b = range_bucket(df, order, buckets, bounds)
    local = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    numbered = with_b.withColumn("__local", local)
    counts = with_b.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    wk = Window.partitionBy(*keys).orderBy("__bucket") if keys else Window.orderBy("__bucket")
    extra = []
    if total_out:
        wt = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        extra = [F.sum("__n").over(wt).alias(total_out)]
    offsets = counts.select(
        *keys, "__bucket",
        (F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__off"), *extra)
    res = _with_offsets(numbered, offsets, keys)
    return res.withColumn(out, (F.col("__off") + F.col("__local")).cast("long")).drop("__bucket", "__local", "__off")


def keyed_prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str, values: Mapping[str, str],
                      tiebreak: Sequence[str] = (), buckets: int | None = None,
                      bounds: DataFrame | None = None) -> DataFrame:
    """Exclusive running sums per ``keys`` in ``order_col`` order, one for each
    ``name: value column`` of ``values``, with the same bucketed plan as
    :func:`keyed_row_number`."""
    keys, order = list(keys), [order_col, *tiebreak]
    with_b = range_bucket(df, order, buckets, bounds)
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = list(values)
    numbered = with_b.select("*", *(F.coalesce(F.sum(values[n]).over(w), F.lit(0)).alias(f"__local_{n}") for n in names))
    sums = with_b.groupBy(*keys, "__bucket").agg(*(F.sum(values[n]).alias(f"__s_{n}") for n in names))
    wk = (Window.partitionBy(*keys).orderBy("__bucket") if keys else Window.orderBy("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__s_{n}").over(wk), F.lit(0)).alias(f"__off_{n}") for n in names))
    res = _with_offsets(numbered, offsets, keys)
    for n in names:
        res = res.withColumn(n, F.col(f"__off_{n}") + F.col(f"__local_{n}"))
    return res.drop("__bucket", *(f"__local_{n}" for n in names), *(f"__off_{n}" for n in names))


def keyed_prefix_sum(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str,
                     tiebreak: Sequence[str] = (), out: str = "offset", buckets: int | None = None,
                     bounds: DataFrame | None = None) -> DataFrame:
    """One of :func:`keyed_prefix_sums`: the offset of each row in a packed stream."""
    return keyed_prefix_sums(df, keys, order_col, {out: value_col}, tiebreak, buckets, bounds)


def global_index(df: DataFrame, order_col: str, tiebreak: Sequence[str] = (),
                 out: str = "_seq", buckets: int | None = None, bounds: DataFrame | None = None,
                 total_out: str | None = None) -> DataFrame:
    """K0: stable 0-based global position by ``order_col`` (then ``tiebreak``);
    ``total_out`` attaches the row count as well."""
    return keyed_row_number(df, [], order_col, tiebreak, out, buckets, bounds, total_out)


def file_order_index(df: DataFrame, out: str = "_seq") -> DataFrame:
    """O1 stable_file_order as a position: order by (file path, row index)
    from the Parquet ``_metadata`` column."""
    d = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    return global_index(d, "__f", tiebreak=["__r"], out=out).drop("__f", "__r")

