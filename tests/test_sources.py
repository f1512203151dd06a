"""Sources: JSONL quarantine, Arrow IPC, recursive scans, guards."""

import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posttrain.session import checkpoint_dir
from posttrain.sources import io


def _dir(spark, name):
    p = os.path.join(checkpoint_dir(spark), "test-src", f"{name}-{uuid.uuid4().hex[:8]}")
    os.makedirs(p, exist_ok=True)
    return p


def test_jsonl_blank_and_bad_lines(spark):
    d = _dir(spark, "jsonl")
    with open(f"{d}/a.jsonl", "w") as f:
        f.write('{"conv_id": 1, "message": [{"role": "user", "content": "hi"}]}\n\n')
        f.write('{"conv_id": 2, "messages": [oops\n')
        f.write('{"conv_id": 3, "messages": [{"role": "assistant", "content": "ok"}]}\n')
    good, bad = io.read_jsonl(spark, d, io.SFT_SCHEMA)
    assert sorted(r.conv_id for r in good.collect()) == [1, 3]
    assert bad.count() == 1


def test_arrow_ipc_reader(spark):
    d = _dir(spark, "arrow")
    t = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "lang": ["en", "fr", "de"]})
    with pa.ipc.new_file(f"{d}/x.arrow", t.schema) as w:
        w.write_table(t)
    df = io.load_source(spark, f"{d}/x.arrow", "doc_id long, lang string")
    assert sorted((r.doc_id, r.lang) for r in df.collect()) == [(1, "en"), (2, "fr"), (3, "de")]


def test_source_guard(spark):
    with pytest.raises(ValueError):
        io.source_guard(spark, "/nonexistent/path/x.parquet")
    d = _dir(spark, "empty")
    spark.range(0).write.mode("overwrite").parquet(f"{d}/e")
    with pytest.raises(ValueError):
        io.source_guard(spark, f"{d}/e")


def test_scan_dir_mixed_case_and_formats(spark):
    d = _dir(spark, "tree")
    spark.createDataFrame([(1, "a")], "conv_id long, text string").write.parquet(f"{d}/p")
    os.makedirs(f"{d}/j/deep", exist_ok=True)
    with open(f"{d}/j/deep/x.JSONL", "w") as f:
        f.write('{"conv_id": 2, "text": "b"}\n')
    with open(f"{d}/j/readme.txt", "w") as f:
        f.write("not data\n")
    from pyspark.sql import types as T
    df = io.scan_dir(spark, d, T._parse_datatype_string("conv_id long, text string"))
    assert sorted(r.conv_id for r in df.select("conv_id").collect()) == [1, 2]


def test_load_reward_func_from_file(spark):
    from posttrain.functions import udf
    d = _dir(spark, "rf")
    with open(f"{d}/rm.py", "w") as f:
        f.write("def reward_func(queries, prompts, labels, **kw):\n"
                "    return {'rewards': [float(len(q)) for q in queries]}\n")
    fn = udf.load_reward_func(f"{d}/rm.py")
    df = spark.createDataFrame([("ab", "p", "l"), ("abc", "p", "l")], "query string, prompt string, label string")
    r = udf.apply_reward_func(df, fn, ds_col=None).orderBy("query").collect()
    assert [x.reward for x in r] == [2.0, 3.0] and [x.score for x in r] == [2.0, 3.0]
