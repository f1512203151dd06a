"""Views over the driver's tables that stand in for the post-training inputs
(rollouts, token rows, code-eval outcomes, preference pairs, chat turns, logits).

Each view has a Spark builder and the equivalent SQL text (used by the DuckDB
oracle, and runnable by Spark SQL as well). Double literals are written
``1.0e0`` so both engines read them as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttrain.operators.index import keyed_row_number
from posttrain.session import table

GROUP_SIZE = 4  # samples per prompt in fx_rollouts

FX_SQL = {
    "fx_rollouts": """
SELECT group_id, prompt_id, CAST(rn % 4 AS INT) AS sample_idx, sample_id, datasource, reward, raw_score, response_length
FROM (SELECT user_id AS prompt_id, event_id AS sample_id, event_type AS datasource, rn,
        user_id*1000 + CAST(floor(rn/4.0) AS BIGINT) AS group_id,
        CASE WHEN value >= 40 THEN 1.0e0 ELSE 0.0e0 END AS reward, value/100.0e0 AS raw_score,
        CAST(floor(value*4) AS INT) AS response_length,
        count(*) OVER (PARTITION BY user_id, CAST(floor(rn/4.0) AS BIGINT)) AS gsz
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) e) x
WHERE gsz = 4""",
    "fx_tokens": """
SELECT l_orderkey AS sample_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS t,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS action_mask,
  -l_quantity/10.0e0 AS log_prob,
  -l_quantity/10.0e0 + (l_discount-0.05e0)*4 AS old_log_prob,
  -l_quantity/10.0e0 + (l_tax-0.04e0)*4 AS base_log_prob,
  -l_quantity/12.0e0 AS teacher_log_prob,
  -l_quantity/10.0e0 + (l_discount-l_tax)*4 AS rollout_log_prob
FROM lineitem""",
    "fx_token_samples": """
SELECT o_orderkey AS sample_id, o_custkey AS group_id, o_totalprice/250000.0e0 - 1.0e0 AS reward,
  o_orderstatus = 'P' AS skip
FROM orders""",
    "fx_responses": """
SELECT doc_id, lang, source, text,
  CASE doc_id % 8
    WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN 'Answer:' || chr(10) || '```js' || chr(10) || text || chr(10) || '```'
    WHEN 2 THEN '```java' || chr(10) || text || chr(10) || '```' || chr(10) || 'done'
    WHEN 3 THEN '```cpp' || chr(10) || text || chr(10) || '```'
    WHEN 4 THEN '```ruby' || chr(10) || text || chr(10) || '```'
    WHEN 5 THEN '```' || chr(10) || text || chr(10) || '```'
    WHEN 6 THEN '```python' || chr(10) || 'def f():' || chr(10) || '    return 1' || chr(10) || '```' || chr(10)
                || '```python' || chr(10) || text || chr(10) || '```'
    ELSE text END AS response,
  CASE doc_id % 3
    WHEN 0 THEN '[ANSWER]' || text || '[/ANSWER]'
    WHEN 1 THEN '[ANSWER] x [/ANSWER] then [ANSWER]assert f(' || CAST(doc_id AS VARCHAR) || ') == ' || lang || '[/ANSWER]'
    ELSE text END AS answer_text
FROM documents""",
    "fx_outcomes": """
SELECT d.source AS task_id, d.lang AS datasource, d.doc_id AS completion_id, l.quality = 1 AS passed
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_pairs": """
SELECT o_custkey AS prompt_id, max(o_totalprice)/100000.0e0 AS chosen, min(o_totalprice)/100000.0e0 AS rejected
FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
    "fx_sft": """
SELECT conv_id, turn, role, text, length(text) AS n_chars FROM conversations""",
    "fx_logits": """
SELECT vec_id, embedding AS logits, label FROM embeddings""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named fixture views."""
    ctes = ",\n".join(f"{n} AS ({FX_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"


def fx_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: groups of 4 consecutive events of a user (a prompt);
    incomplete trailing groups dropped. The per-user position comes from the
    skew-safe keyed row number, so a hot user is not a single task."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ev = keyed_row_number(ev, ["user_id"], "event_id", out="rn", total_out="__nu")
    gnum = F.floor(F.col("rn") / F.lit(GROUP_SIZE)).cast("long")
    d = ev.select(
        (F.col("user_id") * 1000 + gnum).alias("group_id"),
        F.col("user_id").alias("prompt_id"),
        (F.col("rn") % GROUP_SIZE).cast("int").alias("sample_idx"),
        F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("datasource"),
        F.when(F.col("value") >= 40, F.lit(1.0)).otherwise(F.lit(0.0)).alias("reward"),
        (F.col("value") / F.lit(100.0)).alias("raw_score"),
        F.floor(F.col("value") * 4).cast("int").alias("response_length"),
        F.col("rn").alias("__rn"), F.col("__nu"),
    )
    # complete groups only: the user's row count comes with the row numbers
    full = F.floor(F.col("__nu") / F.lit(GROUP_SIZE)) * GROUP_SIZE
    return d.filter(F.col("__rn") < full).drop("__rn", "__nu")


def fx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token position; a sample (order) has a bounded number of
    positions, so the per-sample window is bounded by the sequence length."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lp = -F.col("l_quantity") / F.lit(10.0)
    return li.select(
        F.col("l_orderkey").alias("sample_id"),
        (F.row_number().over(w) - 1).cast("int").alias("t"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("action_mask"),
        lp.alias("log_prob"),
        (lp + (F.col("l_discount") - F.lit(0.05)) * 4).alias("old_log_prob"),
        (lp + (F.col("l_tax") - F.lit(0.04)) * 4).alias("base_log_prob"),
        (-F.col("l_quantity") / F.lit(12.0)).alias("teacher_log_prob"),
        (lp + (F.col("l_discount") - F.col("l_tax")) * 4).alias("rollout_log_prob"),
    )


def fx_token_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token-table sample (an order): its prompt group (customer),
    scalar reward and a skip flag."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"),
                    (F.col("o_totalprice") / F.lit(250000.0) - F.lit(1.0)).alias("reward"),
                    (F.col("o_orderstatus") == "P").alias("skip"))


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses built from whole documents: code fences chosen by
    ``doc_id % 8`` (python, js, java, cpp, ruby, bare, two blocks, none) and
    ``[ANSWER]`` blocks by ``doc_id % 3``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    t, nl, fence = F.col("text"), F.lit("\n"), "```"

    def wrap(tag, before="", after=""):
        return F.concat(F.lit(before + fence + tag), nl, t, nl, F.lit(fence + after))
    k = F.col("doc_id") % 8
    resp = (F.when(k == 0, wrap("python")).when(k == 1, wrap("js", before="Answer:\n"))
            .when(k == 2, wrap("java", after="\ndone")).when(k == 3, wrap("cpp"))
            .when(k == 4, wrap("ruby")).when(k == 5, wrap(""))
            .when(k == 6, wrap("python", before=fence + "python\ndef f():\n    return 1\n" + fence + "\n"))
            .otherwise(t))
    j = F.col("doc_id") % 3
    ans = (F.when(j == 0, F.concat(F.lit("[ANSWER]"), t, F.lit("[/ANSWER]")))
           .when(j == 1, F.concat(F.lit("[ANSWER] x [/ANSWER] then [ANSWER]assert f("),
                                  F.col("doc_id").cast("string"), F.lit(") == "), F.col("lang"),
                                  F.lit("[/ANSWER]")))
           .otherwise(t))
    return d.select("doc_id", "lang", "source", "text", resp.alias("response"), ans.alias("answer_text"))


def fx_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("source").alias("task_id"), F.col("lang").alias("datasource"),
        F.col("doc_id").alias("completion_id"), (F.col("quality") == 1).alias("passed"))


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").alias("prompt_id"))
            .agg((F.max("o_totalprice") / F.lit(100000.0)).alias("chosen"),
                 (F.min("o_totalprice") / F.lit(100000.0)).alias("rejected"),
                 F.count(F.lit(1)).alias("__n"))
            .filter("__n > 1").drop("__n"))


def fx_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text", F.length("text").cast("long").alias("n_chars"))


def fx_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"), "label")
