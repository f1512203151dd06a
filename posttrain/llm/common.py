"""Shared helpers of the llm operators: column hygiene, training splits, bounded
sketches and stage tables in the shared folder."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posttrain.session import checkpoint_dir, ship_package, table

ID, TEXT = "doc_id", "text"


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select(ID, TEXT, *extra)


def narrow(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, *extra: str) -> DataFrame:
    """Only the named columns, under fixed names: extra input columns and names
    that clash with an operator's own columns cannot reach its plan."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(ID), F.col(text_col).cast("string").alias(TEXT), *extra)


def split_no(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % parts


#: With it, Spark removes a query's shuffle files when the query ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later stages and
    retried tasks start from the files, not from the lineage. The shuffle files of
    the written plan are of no more use and go at once, so the stages of an operator
    do not add up on the executors' disks."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that no later plan reads: what comes from
    them is stored itself, so a lost executor never needs them again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the machine. A Python worker outlives its task; without
    this it keeps the most that any of its tasks has used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch. Column types follow ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
        give_back()
    return df.mapInArrow(run, schema)


def key_bitmap(keys: DataFrame, hashed: Column, bits: int = 24) -> np.ndarray:
    """Membership bitmap of a column of 64-bit hashes: bit ``hash mod 2^bits`` is
    set for every key. Its size is fixed by ``bits`` (2^24 bits: 2 MB, sent as at
    most 2^(bits-6) words), whatever the number of keys; more keys only mean more
    false positives, which an exact join after it removes."""
    words = (keys.select(hashed.alias("h")).where("h IS NOT NULL")
             .select((F.pmod("h", F.lit(1 << bits)) / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(h, 64L) as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Rows whose 64-bit hash hits the bitmap."""
    h = hashed.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def bounded_sample(rows: DataFrame, id_col: str, limit: int, salt: int) -> DataFrame:
    """About ``limit`` rows at most (within sampling error of a few per cent),
    chosen by a salted hash of the id; all rows when there are fewer."""
    n = rows.count()
    if n <= limit:
        return rows
    share = int(limit / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) < share)


def log_odds_fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3,
                 steps: int = 30) -> np.ndarray:
    """Weights (the last one is the intercept) of a ridge logistic regression on
    soft targets, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    m = np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), ridge * m.sum())
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (m * (p - target)) + penalty * w
        hess = (x1 * (m * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w
