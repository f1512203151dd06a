"""Query keys for answer extraction and string/JSON scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posttrain.functions import text as tx
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import materialize, table

RS = ("fx_responses",)
T = ("fx_tokens",)

# DuckDB twin of pystrip
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


@query("extract_code_last", f"""
SELECT doc_id, coalesce({_strip("regexp_extract_all(response, '(?s)```(?:python|go|ts|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh)(.*?)```', 1)[-1]")}, 'raise') AS code
FROM fx_responses""", RS)
def q_extract_code_last(spark, sf):
    r = fx.fx_responses(spark, sf)
    return r.select("doc_id", tx.extract_code_last(F.col("response")).alias("code"))


@query("extract_code_multi", f"""
SELECT doc_id, coalesce({_strip("regexp_extract_all(response, '(?s)```(?:python|go|rs|rust|ts|scala|d|r|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh|julia|swift|perl|lua|rkt|racket|rb|ruby)(.*?)```', 1)[-1]")}, {_strip("response")}) AS code
FROM fx_responses""", RS)
def q_extract_code_multi(spark, sf):
    r = fx.fx_responses(spark, sf)
    return r.select("doc_id", tx.extract_code_multi(F.col("response")).alias("code"))


@query("extract_code_def", f"""
SELECT doc_id, coalesce({_strip("coalesce(list_filter(b, lambda x: contains(x, 'def'))[-1], b[-1])")}, 'none') AS code
FROM (SELECT doc_id, regexp_extract_all(response, '(?s)```(?:python\\s*)?([\\s\\S]*?)```', 1) AS b FROM fx_responses) x""", RS)
def q_extract_code_def(spark, sf):
    r = fx.fx_responses(spark, sf)
    return r.select("doc_id", tx.extract_code_def(F.col("response")).alias("code"))


@query("extract_answer", f"""
SELECT doc_id, coalesce({_strip("regexp_extract_all(answer_text, '(?s)\\[ANSWER\\](.*?)\\[/ANSWER\\]', 1)[-1]")}, 'raise') AS answer
FROM fx_responses""", RS)
def q_extract_answer(spark, sf):
    r = fx.fx_responses(spark, sf)
    return r.select("doc_id", tx.extract_answer(F.col("answer_text")).alias("answer"))


@query("answer_gate", f"""
SELECT doc_id, CASE WHEN contains(a, 'assert') THEN CASE WHEN lang = 'en' THEN 1.0e0 ELSE 0.5e0 END ELSE 0.0e0 END AS reward
FROM (SELECT doc_id, lang, coalesce({_strip("regexp_extract_all(answer_text, '(?s)\\[ANSWER\\](.*?)\\[/ANSWER\\]', 1)[-1]")}, 'raise') AS a
      FROM fx_responses) x""", RS)
def q_answer_gate(spark, sf):
    r = fx.fx_responses(spark, sf)
    block = tx.extract_answer(F.col("answer_text"))
    score = F.when(F.col("lang") == "en", F.lit(1.0)).otherwise(F.lit(0.5))
    return r.select("doc_id", tx.answer_gate(block, score).alias("reward"))


@query("test_program", f"""
SELECT doc_id, coalesce({_strip("regexp_extract_all(response, '(?s)```(?:python|go|ts|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh)(.*?)```', 1)[-1]")}, 'raise')
  || chr(10) || 'assert check(' || source || ')' AS program
FROM fx_responses""", RS)
def q_test_program(spark, sf):
    r = fx.fx_responses(spark, sf)
    test = F.concat(F.lit("assert check("), F.col("source"), F.lit(")"))
    return r.select("doc_id", tx.test_program(tx.extract_code_last(F.col("response")), test).alias("program"))


@query("guide_text", f"""
SELECT conv_id, turn, CASE WHEN length({_strip("chr(10) || 'Here is a reference solution:' || chr(10) || text")}) > 0
  THEN chr(10) || 'Here is a reference solution:' || chr(10) || text END AS guide
FROM conversations WHERE role = 'assistant'""")
def q_guide_text(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn",
                    tx.guide_text(F.col("text"), "\nHere is a reference solution:\n").alias("guide"))


@query("guide_text_blank", f"""
SELECT conv_id, turn, CASE WHEN length({_strip("'' || regexp_replace(text, '[^ ]', '', 'g')")}) > 0
  THEN regexp_replace(text, '[^ ]', '', 'g') END AS guide
FROM conversations""")
def q_guide_text_blank(spark, sf):
    """T6 rejection path: labels that are only whitespace give null."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn",
                    tx.guide_text(F.regexp_replace("text", "[^ ]", ""), "").alias("guide"))


@query("parse_logprobs", """
, x AS (SELECT sample_id, list(CASE WHEN action_mask = 1 THEN teacher_log_prob END ORDER BY t) AS lps,
               list('t' || CAST(t AS VARCHAR) ORDER BY t) AS toks FROM fx_tokens GROUP BY sample_id),
j AS (SELECT sample_id, to_json({'choices': [{'logprobs': {'token_logprobs': lps,
        'tokens': CASE WHEN sample_id % 2 = 1 THEN list_append(toks, 'eos') ELSE toks END}}]}) AS js FROM x),
p AS (SELECT sample_id, CAST(json_extract(js, '$.choices[0].logprobs.token_logprobs') AS DOUBLE[]) AS lps,
             CAST(json_extract(js, '$.choices[0].logprobs.tokens') AS VARCHAR[]) AS toks FROM j),
q AS (SELECT sample_id, list_filter(CASE WHEN len(toks) > 0 AND len(lps) = len(toks) THEN lps[2:] ELSE lps END,
                                    lambda v: v IS NOT NULL) AS o FROM p)
SELECT sample_id, CAST(len(o) AS INT) AS n_lp, round(coalesce(list_sum(o), 0.0e0), 6) AS sum_lp FROM q""", T)
def q_parse_logprobs(spark, sf):
    t = fx.fx_tokens(spark, sf)
    per = t.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(
        "t", F.when(F.col("action_mask") == 1, F.col("teacher_log_prob")).alias("lp")))).alias("a"))
    toks = F.transform("a", lambda e: F.concat(F.lit("t"), e["t"].cast("string")))
    toks = F.when(F.col("sample_id") % 2 == 1, F.concat(toks, F.array(F.lit("eos")))).otherwise(toks)
    js = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.transform("a", lambda e: e["lp"]).alias("token_logprobs"), toks.alias("tokens")).alias("logprobs")))
        .alias("choices")))
    o = tx.parse_logprobs(js)
    d = per.select("sample_id", o.alias("o"))
    return d.select("sample_id", F.size("o").alias("n_lp"),
                    rnd(F.aggregate("o", F.lit(0.0), lambda acc, v: acc + v)).alias("sum_lp"))


@query("parse_ds_set", """
SELECT event_id, CASE WHEN r = 'all' THEN NULL WHEN r IN ('none', '') THEN ''
  ELSE array_to_string(list_filter(list_transform(string_split(r, ','), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), '|') END AS ds_set
FROM (SELECT event_id, lower(regexp_replace(CASE WHEN value < 5 THEN ' ALL ' WHEN value < 10 THEN ' none'
         WHEN value < 12 THEN '' ELSE ' ' || upper(event_type) || ' , ' || props || ',,view ' END, '^\\s+|\\s+$', '', 'g')) AS r
      FROM events) x""")
def q_parse_ds_set(spark, sf):
    e = table(spark, sf, "events")
    raw = (F.when(F.col("value") < 5, F.lit(" ALL ")).when(F.col("value") < 10, F.lit(" none"))
           .when(F.col("value") < 12, F.lit(""))
           .otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" , "), F.col("props"), F.lit(",,view "))))
    s = tx.parse_ds_set(raw)
    return e.select("event_id", F.array_join(s, "|").alias("ds_set"))


@query("truncate_prompt_left", """
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n_ids, CAST(len(kept) AS INT) AS n_kept,
  array_to_string(kept, ' ') AS kept_text
FROM (SELECT conv_id, turn, ids, CASE WHEN len(ids) <= 12 THEN ids ELSE ids[len(ids) - 12 + 1:] END AS kept
      FROM (SELECT conv_id, turn, regexp_extract_all(text, '(\\w+|[^\\w\\s]+)', 1) AS ids FROM conversations) a) b""")
def q_truncate_prompt_left(spark, sf):
    c = table(spark, sf, "conversations")
    ids = F.regexp_extract_all("text", F.lit(r"(\w+|[^\w\s]+)"), 1)
    d = c.select("conv_id", "turn", ids.alias("ids"))
    kept = tx.truncate_left(F.col("ids"), 12)
    return d.select("conv_id", "turn", F.size("ids").alias("n_ids"), F.size(kept).alias("n_kept"),
                    F.array_join(kept, " ").alias("kept_text"))


@query("render_chat", """
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
  || '<|im_start|>assistant' || chr(10) AS prompt_text
FROM conversations GROUP BY conv_id""")
def q_render_chat(spark, sf):
    from posttrain.operators.sft import render_chat
    return render_chat(table(spark, sf, "conversations"))


@query("tokenize", """
SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(\\w+|[^\\w\\s]+)', 1)) AS INT) AS n_tokens
FROM conversations""")
def q_tokenize(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(tx.tokenize(F.col("text"))).alias("n_tokens"))


_PIECES = r"regexp_extract_all(text, '[\x20\x09-\x0D]+|[0-9A-Za-z_]+|[^\x20\x09-\x0D0-9A-Za-z_]+')"


@query("tokenize_vocabulary", f"""
, p AS (SELECT conv_id, turn, text, {_PIECES} AS ps FROM conversations),
e AS (SELECT conv_id, turn, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM p),
v AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS id FROM (
  SELECT piece, count(*) AS n FROM e GROUP BY piece HAVING count(*) >= 2)),
x AS (SELECT conv_id, turn, array_to_string(list(coalesce(v.id, 0) ORDER BY k), ',') AS ids,
        array_to_string(list(coalesce(v.piece, '?') ORDER BY k), '') AS decoded FROM e LEFT JOIN v USING (piece) WHERE k <= 200 GROUP BY conv_id, turn)
SELECT p.conv_id, p.turn, coalesce(ids, '') AS ids, coalesce(decoded, '') AS decoded FROM p LEFT JOIN x USING (conv_id, turn)""")
def q_tokenize_vocabulary(spark, sf):
    """T12 with a vocabulary built from all turns: ids, cut at 200, and their text."""
    from posttrain.operators import vocab
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    words = materialize(vocab.build_vocabulary(c, min_count=2), "vocabulary")
    ids = materialize(vocab.encode(c, words, ["conv_id", "turn"], max_length=200), "ids")  # both are read more than once
    text = vocab.decode(ids, words, ["conv_id", "turn", "ids"], unknown="?", out="decoded")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return text.where(named).select("conv_id", "turn", F.array_join("ids", ",").alias("ids"), "decoded")


@query("detokenize", """
SELECT doc_id, coalesce(text, '') AS text FROM documents""")
def q_detokenize(spark, sf):
    """T12 there and back over whole documents: with every piece in the vocabulary the
    ids give the text again."""
    from posttrain.operators import vocab
    d = table(spark, sf, "documents").select("doc_id", "text")
    words = materialize(vocab.build_vocabulary(d), "vocabulary")
    ids = materialize(vocab.encode(d, words, ["doc_id"]), "ids")  # both are read more than once
    return vocab.decode(ids, words, ["doc_id"])


@query("candidates_x_tests", """
, c AS (SELECT source AS task_id, doc_id AS completion_id,
          coalesce(regexp_replace(regexp_extract_all(response, '(?s)```(?:python|go|ts|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh)(.*?)```', 1)[-1], '^\\s+|\\s+$', '', 'g'), 'raise') AS candidate
        FROM fx_responses),
t AS (SELECT DISTINCT source AS task_id, 'assert check(' || source || ')' AS test FROM documents)
SELECT c.task_id, c.completion_id, md5(c.candidate || chr(10) || t.test) AS program_md5, CAST(length(c.candidate || chr(10) || t.test) AS INT) AS program_len
FROM c JOIN t ON c.task_id = t.task_id""", RS)
def q_candidates_x_tests(spark, sf):
    """Every candidate of a task paired with that task's test program."""
    from posttrain.operators.routing import candidates_x_tests
    r = fx.fx_responses(spark, sf)
    cands = r.select(F.col("source").alias("task_id"), F.col("doc_id").alias("completion_id"),
                     tx.extract_code_last(F.col("response")).alias("candidate"))
    tests = table(spark, sf, "documents").select(F.col("source").alias("task_id")).distinct().select(
        "task_id", F.concat(F.lit("assert check("), F.col("task_id"), F.lit(")")).alias("test"))
    d = candidates_x_tests(cands, tests)
    return d.select("task_id", "completion_id", F.md5("program").alias("program_md5"),
                    F.length("program").alias("program_len"))
