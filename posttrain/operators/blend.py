"""Dataset blending (U1-U4) and set helpers.

``interleave`` re-expresses weighted interleaving with recycling as a draw
table: draw ``t`` picks a source from a hash-uniform number and the source's
cumulative probability; the k-th draw of source i takes that source's row
``k mod n_i``; the table stops at the first draw after which every source has
been drawn at least ``n_i`` times ("all exhausted"). The draw order is
md5-based (deterministic across engines), not a particular library's RNG.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posttrain.operators.index import keyed_row_number

HEX_DIGITS = 13  # 52 bits: exact in a double


def hash_uniform(seed: int, t: Column) -> Column:
    """Uniform [0, 1) from md5('seed:t')."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), t.cast("string")))
    return F.conv(F.substring(h, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** HEX_DIGITS))


def concat_datasets(frames: Sequence[DataFrame], order_col: str, tiebreak: Sequence[str] = (), max_count: int | None = None,
                    overall: int | None = None) -> DataFrame:
    """U1 with S9: union by name with ``(source_idx, row_idx)`` as the stable order; the
    first ``max_count`` rows of each frame, then the first ``overall`` of all."""
    out = None
    for i, f in enumerate(frames):
        g = keyed_row_number(f.withColumn("source_idx", F.lit(i)), [], order_col, tiebreak=tiebreak, out="row_idx")
        g = g if max_count is None else g.where(F.col("row_idx") < max_count)
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out if overall is None else out.orderBy("source_idx", "row_idx").limit(overall)


#: Draws that one task numbers at once.
DRAW_BLOCK = 1 << 16


def interleave(spark: SparkSession, sources: DataFrame, probs: Sequence[float], seed: int = 42,
               source_col: str = "source_idx", order_col: str = "id") -> DataFrame:
    """Weighted interleave with recycling until all sources are exhausted.

    ``sources`` holds every source's rows tagged by ``source_col`` (0..k-1);
    rows of a source are taken in ``order_col`` order. Output: the source
    rows in draw order with ``draw`` (the position in the interleaved stream).

    No job runs while the plan is built. The number of draws comes from the counts of
    the sources: the draws until a source of n rows and probability p is exhausted
    lie twelve standard deviations and 300 / p draws above their mean with a probability
    below 1e-30; a stream that needs more, or a source without rows, fails the query.
    A row that is drawn again and again is listed once for each of its turns, so each
    draw meets one row of its own and a small source is no hot key."""
    if abs(sum(probs) - 1.0) > 1e-6 or min(probs) <= 0:
        raise ValueError("probabilities must be above 0 and sum to 1")
    k = len(probs)
    cum = [sum(probs[: i + 1]) for i in range(k)]
    counts = sources.groupBy(source_col).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(source_col).cast("int").alias("s"), "n"))).alias("m")).scalar()

    def size(i: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, i), F.raise_error(F.lit("every source needs at least one row")).cast("long"))

    need = [F.ceil((size(F.lit(i)) + 12 * F.sqrt(size(F.lit(i)) * (1 - p)) + 300) / p) for i, p in enumerate(probs)]
    total = F.greatest(*need) if k > 1 else need[0]
    blocks = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(total / DRAW_BLOCK).cast("long"))).alias("__block"))
    first = F.col("__block") * DRAW_BLOCK
    draws = blocks.repartition("__block").select(F.explode(F.sequence(first, first + DRAW_BLOCK - 1)).alias("draw"))
    u = hash_uniform(seed, F.col("draw"))
    pick = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        pick = F.when(u < F.lit(cum[i]), F.lit(i)).otherwise(pick)
    draws = draws.withColumn(source_col, pick.cast("int"))
    # k-th draw of each source; a popular source is spread by the keyed row number
    draws = keyed_row_number(draws, [source_col], "draw", out="__k", buckets=spark.sparkContext.defaultParallelism)
    n = size(F.col(source_col))
    last = draws.where(F.col("__k") == n - 1).agg(F.when(F.count(F.lit(1)) == k, F.max("draw")).alias("end"))
    end = F.coalesce(last.scalar(), F.raise_error(F.lit("the draws ended before every source was exhausted")).cast("long"))
    drawn = draws.where(F.col("draw") <= end)
    turns = drawn.groupBy(source_col).agg(F.max("__k").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(source_col, "n")))).scalar()
    rows = keyed_row_number(sources, [source_col], order_col, out="__row")
    most = F.try_element_at(turns, F.col(source_col).cast("int"))
    rows = rows.withColumn("__k", F.explode(F.when(most >= F.col("__row"), F.sequence(F.col("__row"), most, size(F.col(source_col).cast("int"))))))
    return drawn.withColumn(source_col, F.col(source_col).cast(sources.schema[source_col].dataType)).join(rows, [source_col, "__k"]).drop("__k", "__row")


def shared_keys(keys_per_chunk: DataFrame, chunk_col: str, key_col: str) -> DataFrame:
    """Keys present in every chunk, as one sorted array (array_intersect
    fold over the per-chunk key sets; the number of chunks is bounded by the
    number of micro-batches of a step)."""
    sets = keys_per_chunk.groupBy(chunk_col).agg(F.array_sort(F.collect_set(key_col)).alias("__s"))
    all_sets = sets.agg(F.collect_list("__s").alias("__l"))
    return all_sets.select(F.array_sort(F.aggregate(
        F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(1))), F.element_at("__l", 1),
        lambda acc, s: F.array_intersect(acc, s))).alias("keys"))
