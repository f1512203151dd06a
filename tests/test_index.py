"""Positions under skew: the bucketed row number equals a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from posttrain.operators.index import global_index, keyed_prefix_sum, keyed_row_number, range_bucket
from posttrain.operators.sizing import broadcast_if_small, estimated_bytes, input_bytes


def _same_as_window(d, keys, order, buckets, id_col="id"):
    got = keyed_row_number(d, keys, order[0], tiebreak=order[1:], out="rn", buckets=buckets)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ref = d.select(id_col, (F.row_number().over(w.orderBy(*order)) - 1).alias("rn2"))
    a = {r[id_col]: r["rn"] for r in got.collect()}
    b = {r[id_col]: r["rn2"] for r in ref.collect()}
    assert a == b and got.count() == d.count()


@pytest.mark.parametrize("buckets", [1, 2, 16, 600])
def test_keyed_row_number_with_hot_key(spark, buckets):
    # key 0 holds a third of the rows
    d = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
                                 ((F.col("id") * 7919) % 3001).alias("o")).repartition(7)
    _same_as_window(d, ["k"], ["o", "id"], buckets)


def test_null_keys_and_null_order_values_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "k", None if i % 4 == 0 else float(i % 7)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, k string, o double").repartition(5)
    _same_as_window(d, ["k"], ["o", "id"], 16)
    _same_as_window(d, [], ["o", "id"], 16)


def test_string_order_key(spark):
    d = spark.range(700).select("id", F.md5(F.col("id").cast("string")).alias("o")).repartition(4)
    _same_as_window(d, [], ["o"], 16)


def test_equal_values_are_split_by_the_tiebreak(spark):
    d = spark.range(8000).select("id", F.lit(1).alias("o")).repartition(4)
    _same_as_window(d, [], ["o", "id"], 16)
    sizes = [r["count"] for r in range_bucket(d, ["o", "id"], 16).groupBy("__bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 8000 // 4


def test_buckets_are_monotone(spark):
    d = spark.range(5000).select(((F.col("id") * 104729) % 5003).alias("o")).repartition(5)
    rows = range_bucket(d, "o", 600).orderBy("o").collect()
    assert all(x["__bucket"] <= y["__bucket"] for x, y in zip(rows, rows[1:], strict=False))
    assert len({r["__bucket"] for r in rows}) > 400


def test_empty_table(spark):
    d = spark.range(0).select("id", F.col("id").alias("o"))
    assert global_index(d, "o", buckets=8).collect() == []


def test_no_job_while_the_plan_is_built(spark):
    d = spark.range(1000).withColumn("v", F.assert_true(F.lit(False), "the plan ran").cast("string"))
    global_index(d, "id", tiebreak=["v"], out="s", total_out="n")


def test_global_index_is_dense_and_ordered(spark):
    d = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v")).repartition(5)
    r = global_index(d, "v", out="s", total_out="n").orderBy("s").collect()
    assert [x.s for x in r] == list(range(1000)) == [x.v for x in r] and {x.n for x in r} == {1000}


def test_keyed_prefix_sum(spark):
    d = spark.createDataFrame([(i % 2 or None, i, None if i == 4 else i + 1) for i in range(10)], "k int, o long, v long")
    got = {(r.k, r.o): r.offset for r in keyed_prefix_sum(d, ["k"], "o", "v", buckets=4).collect()}
    for k in (None, 1):
        acc = 0
        for o in range(k or 0, 10, 2):
            assert got[(k, o)] == acc
            acc += 0 if o == 4 else o + 1


def test_sizes_are_known(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert estimated_bytes(d) == size and input_bytes(d.crossJoin(d)) == 2 * size
    assert "BroadcastHashJoin" in spark.range(10).join(broadcast_if_small(d), "id")._jdf.queryExecution().executedPlan().toString()
    assert broadcast_if_small(d, limit=size - 1) is d
