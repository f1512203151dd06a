"""Query keys for SFT shaping and collation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posttrain.functions import text as tx
from posttrain.operators import sft
from posttrain.plans.registry import query
from posttrain.session import table

MAX_LEN = 256
TOK = "(\\w+|[^\\w\\s]+)"


def _ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOK}', 1))"


_RENDER = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_GEN = _ntok("'<|im_start|>assistant' || chr(10)")


def _prefix_sql(src: str = "conversations", last_only: bool = False, think: bool = False) -> str:
    think_sql = (" - CASE WHEN role = 'assistant' AND idx <> last_asst AND last_asst > 2 THEN 4 ELSE 0 END"
                 if think else "")
    bit = "role = 'assistant' AND idx = last_asst" if last_only else "role = 'assistant'"
    return f"""
, t0 AS (SELECT conv_id, turn, role, {_ntok(_RENDER)} AS n_tok,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM {src}),
t1 AS (SELECT *, coalesce(max(CASE WHEN role = 'assistant' THEN idx END) OVER (PARTITION BY conv_id), -1) AS last_asst FROM t0),
t2 AS (SELECT *, sum(n_tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              + CASE WHEN role IN ('system', 'user') THEN {_GEN} ELSE 0 END{think_sql} AS prefix_len FROM t1),
t3 AS (SELECT *, coalesce(max(prefix_len) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM t2),
t4 AS (SELECT *, greatest(prefix_len - cursor, 0) AS new_tokens, CASE WHEN {bit} THEN 1 ELSE 0 END AS bit FROM t3),
shaped AS (SELECT conv_id, least(sum(n_tok), {MAX_LEN}) AS n_ids, least(sum(new_tokens), {MAX_LEN}) AS n_lab,
             sum(bit * greatest(least(new_tokens, {MAX_LEN} - cursor), 0)) AS n_target FROM t4 GROUP BY conv_id)"""


def _shaped_out():
    return f"""
SELECT conv_id, CASE WHEN n_ids = n_lab THEN CAST(n_ids AS INT) END AS n_ids,
  CASE WHEN n_ids = n_lab THEN CAST(n_target AS BIGINT) END AS n_target,
  CASE WHEN n_ids <> n_lab THEN 'length mismatch' END AS error FROM shaped"""


def _shape_summary(d):
    return d.select("conv_id", F.size("input_ids").alias("n_ids"),
                    F.aggregate("target_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_target"), "error")


@query("role_mask", _prefix_sql() + _shaped_out())
def q_role_mask(spark, sf):
    return _shape_summary(sft.shape_chat(table(spark, sf, "conversations"), MAX_LEN))


@query("last_assistant_only", _prefix_sql(last_only=True) + _shaped_out())
def q_last_assistant_only(spark, sf):
    return _shape_summary(sft.shape_chat(table(spark, sf, "conversations"), MAX_LEN, last_assistant_only=True))


@query("think_offset", ", nosys AS (SELECT * FROM conversations WHERE role <> 'system')"
       + _prefix_sql("nosys", last_only=True, think=True) + _shaped_out())
def q_think_offset(spark, sf):
    d = sft.shape_chat(table(spark, sf, "conversations"), MAX_LEN, drop_system=True,
                       last_assistant_only=True, think_offset=True)
    return _shape_summary(d)


@query("row_quarantine", _prefix_sql() + """
SELECT conv_id, 'length mismatch' AS error FROM shaped WHERE n_ids <> n_lab""")
def q_row_quarantine(spark, sf):
    d = sft.shape_chat(table(spark, sf, "conversations"), MAX_LEN)
    return d.filter(F.col("error").isNotNull()).select("conv_id", "error")


@query("prefix_lengths", _prefix_sql() + """
SELECT conv_id, turn, CAST(n_tok AS INT) AS n_tok, CAST(prefix_len AS BIGINT) AS prefix_len,
  CAST(cursor AS BIGINT) AS cursor, CAST(new_tokens AS BIGINT) AS new_tokens FROM t4""")
def q_prefix_lengths(spark, sf):
    d = sft.turn_prefix_lengths(table(spark, sf, "conversations"))
    return d.select("conv_id", "turn", "n_tok", F.col("prefix_len").cast("long").alias("prefix_len"),
                    F.col("cursor").cast("long").alias("cursor"), F.col("new_tokens").cast("long").alias("new_tokens"))


@query("drop_system_turns", """
SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'""")
def q_drop_system_turns(spark, sf):
    return sft.drop_system_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("concat_mode", f"""
SELECT conv_id, CAST(sum({_ntok("text")}) AS INT) AS n_ids,
  CAST(sum(CASE WHEN role = 'assistant' THEN {_ntok("text")} ELSE 0 END) AS BIGINT) AS n_target
FROM conversations GROUP BY conv_id""")
def q_concat_mode(spark, sf):
    d = sft.shape_concat(table(spark, sf, "conversations"))
    return d.select("conv_id", F.size("input_ids").alias("n_ids"),
                    F.aggregate("target_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_target"))


@query("truncate", f"""
SELECT conv_id, CAST(least(sum({_ntok("text")}), 128) AS INT) AS n_ids FROM conversations GROUP BY conv_id""")
def q_truncate(spark, sf):
    d = sft.shape_concat(table(spark, sf, "conversations"))
    return d.select("conv_id", F.size(sft.truncate(F.col("input_ids"), 128)).alias("n_ids"))


_WL = "list_transform(regexp_extract_all(text, '\\w+'), lambda x: CAST(length(x) AS INT))"


def _wordlens(c="text"):
    return F.transform(F.regexp_extract_all(c, F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))


@query("pattern_zero", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids FROM conversations),
b AS (SELECT conv_id, turn, ids, list_transform(range(1, len(ids) + 1), lambda j:
        CASE WHEN len(list_filter(range(greatest(j - 2, 1), j + 1),
                                  lambda s: s + 2 <= len(ids) AND ids[s:s + 2] = [2, 2, 3])) > 0 THEN 0 ELSE 1 END) AS lab FROM a)
SELECT conv_id, turn, CAST(len(list_filter(lab, lambda x: x = 0)) AS INT) AS n_zero, array_to_string(lab, '') AS labels FROM b""")
def q_pattern_zero(spark, sf):
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wordlens().alias("ids"))
    d = d.withColumn("lab", F.array_repeat(F.lit(1), F.size("ids")))
    d = sft.pattern_zero(d, "ids", "lab", (2, 2, 3))
    return d.select("conv_id", "turn", F.size(F.filter("lab", lambda x: x == 0)).alias("n_zero"),
                    F.array_join("lab", "").alias("labels"))


@query("ignore_labels", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(ids, lambda x: CASE WHEN x % 2 = 1 THEN x ELSE -100 END), ',') AS labels FROM a""")
def q_ignore_labels(spark, sf):
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wordlens().alias("ids"))
    d = d.withColumn("m", F.transform("ids", lambda x: x % 2))
    return d.select("conv_id", "turn", F.array_join(sft.ignore_labels(F.col("ids"), F.col("m")), ",").alias("labels"))


@query("pad_label_ignore", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END), ',') AS labels FROM a""")
def q_pad_label_ignore(spark, sf):
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wordlens().alias("ids"))
    return d.select("conv_id", "turn", F.array_join(sft.pad_label_ignore(F.col("ids"), 2), ",").alias("labels"))


@query("build_prompt", """
SELECT conv_id, turn, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat_prompt,
  'Question: ' || text || chr(10) || 'Answer:' AS template_prompt
FROM conversations WHERE role = 'user'""")
def q_build_prompt(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", sft.build_prompt(F.col("text")).alias("chat_prompt"),
                    sft.build_prompt(F.col("text"), template="Question: {}\nAnswer:").alias("template_prompt"))


@query("prompt_defaults", """
SELECT doc_id, coalesce(source, '') AS label, coalesce(nullif(lang, 'en'), 'default') AS datasource FROM documents""")
def q_prompt_defaults(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.nullif(F.col("lang"), F.lit("en")).alias("datasource"))
    return sft.prompt_defaults(d, "source").select("doc_id", "label", "datasource")


_PAIR_SQL = f"""
, u AS (SELECT conv_id, turn, {_WL} AS p FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, {_WL} AS r FROM conversations WHERE role = 'assistant'),
pr AS (SELECT u.conv_id, u.turn, p, r FROM u JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn)"""


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", _wordlens().alias("p"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), _wordlens().alias("r"))
    return u.join(a, ["conv_id", "turn"])


@query("assemble_sample", _PAIR_SQL + """
, s AS (SELECT conv_id, turn, list_concat(p, r)[1:100] AS sq,
          list_concat(list_transform(p, lambda x: 0), list_transform(r, lambda x: 1))[2:100] AS am, len(r) AS rl, len(p) AS pl FROM pr)
SELECT conv_id, turn, array_to_string(sq, ',') AS sequences, array_to_string(am, '') AS action_mask,
  CAST(len(sq) AS INT) AS total_length, CAST(rl AS INT) AS response_length, rl >= 60 AS is_clipped FROM s""")
def q_assemble_sample(spark, sf):
    d = _pairs(spark, sf)
    s = sft.assemble_sample(F.col("p"), F.col("r"), 100, 60)
    return d.select("conv_id", "turn", F.array_join(s["sequences"], ",").alias("sequences"),
                    F.array_join(s["action_mask"], "").alias("action_mask"), s["total_length"].alias("total_length"),
                    s["response_length"].alias("response_length"), s["is_clipped"].alias("is_clipped"))


@query("mask_from_ranges", f"""
, t AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\\w+')) AS n FROM conversations),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS st FROM t),
g AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS total, list({{'start': st, 'end': st + n}}) FILTER (WHERE role = 'assistant') AS rg FROM c GROUP BY conv_id),
m AS (SELECT conv_id, total, CASE WHEN total > 1 THEN list_transform(range(1, total), lambda q:
         CASE WHEN len(list_filter(coalesce(rg, []), lambda x: q >= x['start'] AND q < x['end'])) > 0 THEN 1 ELSE 0 END) ELSE [] END AS am FROM g)
SELECT conv_id, CASE WHEN list_position(am, 1) IS NULL THEN 0
    ELSE len(am) - list_position(list_reverse(am), 1) + 1 - list_position(am, 1) + 1 END AS response_length,
  total >= 300 AS is_clipped, CAST(list_sum(am) AS BIGINT) AS n_action FROM m""")
def q_mask_from_ranges(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.size(F.regexp_extract_all("text", F.lit(r"\w+"), 0)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("st", F.sum("n").over(w) - F.col("n"))
    g = c.groupBy("conv_id").agg(
        F.sum("n").alias("total"),
        F.collect_list(F.when(F.col("role") == "assistant",
                              F.struct(F.col("st").alias("start"), (F.col("st") + F.col("n")).alias("end")))).alias("rg"))
    m = sft.mask_from_ranges(F.col("total"), F.col("rg"), 300)
    d = g.select("conv_id", m.alias("m"))
    return d.select("conv_id", F.col("m.response_length").alias("response_length"), F.col("m.is_clipped").alias("is_clipped"),
                    F.aggregate("m.action_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_action"))


@query("sft_collate", _prefix_sql() + """,
v AS (SELECT conv_id, conv_id // 8 AS batch_id, CASE WHEN n_ids = n_lab THEN n_ids END AS n, n_target FROM shaped),
b AS (SELECT *, coalesce(least(max(n) OVER (PARTITION BY batch_id), 256), 1) AS L FROM v)
SELECT conv_id, CAST(L AS INT) AS width, CAST(L - coalesce(n, 0) AS INT) AS n_pad,
  CAST(L - coalesce(CASE WHEN n IS NULL THEN 0 ELSE n_target END, 0) AS INT) AS n_ignored FROM b""")
def q_sft_collate(spark, sf):
    d = sft.shape_chat(table(spark, sf, "conversations"), MAX_LEN)
    d = d.withColumn("batch_id", (F.col("conv_id") / 8).cast("long"))
    c = sft.sft_collate(d, MAX_LEN, pad_id=0)
    return c.select("conv_id", F.size("input_ids").alias("width"),
                    F.size(F.filter("attention_mask", lambda x: x == 0)).alias("n_pad"),
                    F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"))


@query("pad_sequences", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids, conv_id // 4 AS batch_id FROM conversations),
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS L FROM a)
SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(L - len(ids)), lambda i: -1), ids), ',') AS left_padded,
  CAST(L AS INT) AS width FROM b""")
def q_pad_sequences(spark, sf):
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wordlens().alias("ids"), (F.col("conv_id") / 4).cast("long").alias("batch_id"))
    p = sft.pad_sequences(d, {"ids": -1}, left=True)
    return p.select("conv_id", "turn", F.array_join("ids", ",").alias("left_padded"), F.size("ids").alias("width"))
