"""Corpus pipeline: documents in, token ids out, each stage one llm operator.

``STAGES`` are run in order; each is written as Parquet and read again as the next
one's input. A stage works on every row its predecessor kept, and all but the last
return the columns of ``documents``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttrain.llm import bpe, decontaminate, language_id, line_dedup, minhash
from posttrain.llm.common import split_no
from posttrain.session import checkpoint_dir, ship_package, table


#: A language that gets less than this of all the machines' shares is not identified.
LEAST_SCORE = 0.25


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a language (null text, no letter) go, and those
    whose best language gets a score below ``LEAST_SCORE``."""
    model = language_id.fit(docs.where((split_no("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    told = language_id.tagged(docs, model)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if model is None:  # nothing to learn from: only texts without a letter go
        known = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return told.where(known).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that match an earlier line go; so does a document that has
    no word left. ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs)
    changed = F.size("dropped_lines") > 0
    out = out.where(~(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return out.select(*(F.when(changed, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
                        if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five-word shingles at 0.8: one document of each group stays."""
    groups = minhash.near_duplicates(docs)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct()
    rows = docs.withColumn("__v", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__v") == F.col("__version"))
    # rows that repeat both id and text are one document
    return rows.join(gone, same, "left_anti").dropDuplicates(["doc_id", "__v"]).drop("__v")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: ids of each text, with the digests of ids and decoded bytes."""
    return (bpe.encode_and_decode(docs)
            .select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]

#: Learned models, set-similarity components and token ids: tested against
#: brute-force versions instead of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(checkpoint_dir(spark), "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        path = os.path.join(base, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
