"""Every query key with an oracle: Spark result == DuckDB result on sf0.001
(row count, column names, order-insensitive values with doubles rounded)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

STREAMING = {"filter_accumulate", "fifo_buffer", "bounded_pipeline", "resume", "running_datasource_stats",
             "adaptive_kl_stream"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


KEYS = sorted(k for k in E.oracle_sql() if k not in STREAMING)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_rows, df.columns) == _rows(d_rows, d_cols)


def test_every_key_has_a_callable():
    q = E.queries()
    assert len(q) >= 150
    assert set(E.oracle_sql()) <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["datasource", "n_prompts", "pass4", "pass1"]
