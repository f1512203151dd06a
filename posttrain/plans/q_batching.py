"""Query keys for positions, sharding, batching, packing and balancing
(K0-K13, O2-O6, W10, J4, J10, A13, A18, A19, A22, A24, P21-P23, P25, P27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain.operators import batching as bt
from posttrain.operators import metrics as met
from posttrain.operators import sft
from posttrain.operators.index import global_index
from posttrain.plans import fixtures as fx
from posttrain.plans.registry import query, rnd
from posttrain.session import table

R = ("fx_rollouts",)
T = ("fx_tokens",)
STEP = 64

# rollouts with a global position by sample id
_SEQ = """, s AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS seq FROM fx_rollouts)"""


def _seq(spark, sf):
    # quantiles straight from the events column the sample id comes from
    bounds = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"))
    return global_index(fx.fx_rollouts(spark, sf), "sample_id", out="_seq", bounds=bounds, total_out="__n")


@query("global_index", """
SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS seq FROM events""")
def q_global_index(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return global_index(e, "value", tiebreak=["event_id"], out="seq").select("event_id", "seq")


@query("rank_shard", _SEQ + """,
n AS (SELECT count(*) AS n FROM s),
p AS (SELECT s.sample_id, s.seq, unnest(range(s.seq, CAST(ceil(n.n / 7.0) * 7 AS BIGINT), n.n)) AS pos FROM s, n
      WHERE s.seq < ceil(n.n / 7.0) * 7)
SELECT sample_id, CAST(pos % 7 AS INT) AS rank, CAST(pos // 7 - 2 AS BIGINT) AS local_idx FROM p WHERE pos // 7 - 2 >= 0""", R)
def q_rank_shard(spark, sf):
    d = bt.rank_shard(_seq(spark, sf), 7, drop_last=False, consumed_samples=14)
    return d.select("sample_id", "rank", "local_idx")


@query("rank_shard_drop_last", _SEQ + """,
n AS (SELECT count(*) AS n FROM s)
SELECT sample_id, CAST(seq % 7 AS INT) AS rank, CAST(seq // 7 AS BIGINT) AS local_idx FROM s, n
WHERE seq < (CASE WHEN n.n % 7 <> 0 THEN ceil((n.n - 7) / 7.0) ELSE ceil(n.n / 7.0) END) * 7""", R)
def q_rank_shard_drop_last(spark, sf):
    d = bt.rank_shard(_seq(spark, sf), 7, drop_last=True)
    return d.select("sample_id", "rank", "local_idx")


@query("ceil_chunks", _SEQ + """
SELECT sample_id, CAST(floor(seq / ceil((SELECT count(*) FROM s) / 7.0)) AS BIGINT) AS chunk FROM s""", R)
def q_ceil_chunks(spark, sf):
    d = bt.with_count(_seq(spark, sf))
    return d.select("sample_id", bt.ceil_chunks(F.col("_seq"), F.col("__n"), 7).alias("chunk"))


@query("fixed_micro_batches", _SEQ + """
SELECT sample_id, seq // 16 AS micro_batch FROM s""", R)
def q_fixed_micro_batches(spark, sf):
    return _seq(spark, sf).select("sample_id", bt.fixed_micro_batches(F.col("_seq"), 16).alias("micro_batch"))


@query("drop_ragged_batch", _SEQ + """
SELECT sample_id, seq // 100 AS batch_id FROM s WHERE seq // 100 < (SELECT count(*) FROM s) // 100""", R)
def q_drop_ragged_batch(spark, sf):
    return bt.drop_ragged_batch(_seq(spark, sf), 100).select("sample_id", "batch_id")


@query("snake_balance", _SEQ + """,
r AS (SELECT sample_id, seq // 256 AS step,
        row_number() OVER (PARTITION BY seq // 256 ORDER BY response_length DESC, seq) - 1 AS rk,
        count(*) OVER (PARTITION BY seq // 256) AS N FROM s),
c AS (SELECT *, rk // 8 AS c, rk % 8 AS p, CAST(ceil(N / 8.0) AS BIGINT) AS CC FROM r),
d AS (SELECT *, CC // 2 AS h, CC - CC // 2 AS L, least(8, N - c * 8) AS z FROM c),
e AS (SELECT *, L - 1 - (c - h) AS i FROM d),
f AS (SELECT sample_id, step, CAST(CASE WHEN c < h THEN p ELSE z - 1 - p END AS INT) AS lane,
        CAST(CASE WHEN c < h THEN 2 * c WHEN i < h THEN 2 * i + 1 ELSE 2 * h END AS INT) AS slot,
        CASE WHEN N % 8 = 0 THEN 8 ELSE N % 8 END AS keep FROM e)
SELECT sample_id, step, lane, slot FROM f WHERE lane < keep""", R)
def q_snake_balance(spark, sf):
    d = _seq(spark, sf).withColumn("step", F.floor(F.col("_seq") / 256).cast("long"))
    return bt.snake_balance(d, 8, len_col="response_length", step_col="step").select("sample_id", "step", "lane", "slot")


@query("cap_rollouts", """
, k AS (SELECT * FROM fx_rollouts WHERE group_id IN (SELECT group_id FROM fx_rollouts GROUP BY group_id
          HAVING count(*) = 4 AND avg(raw_score) > 0.2e0 + 1e-6 AND avg(raw_score) < 0.6e0 - 1e-6)),
s AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS seq FROM k)
SELECT sample_id, seq FROM s WHERE seq < 1000""", R)
def q_cap_rollouts(spark, sf):
    from posttrain.operators.routing import dynamic_filter
    k = dynamic_filter(fx.fx_rollouts(spark, sf), 4, (0.2, 0.6), score_col="raw_score")
    head = k.orderBy("sample_id").limit(250 * 4)  # each task keeps its own head
    return global_index(head, "sample_id", out="seq", buckets=1).select("sample_id", "seq")


_H = "CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 15)) AS BIGINT)"


@query("epoch_shuffle", f"""
SELECT sample_id, row_number() OVER (ORDER BY {_H.format(seed=45, col='sample_id')}, sample_id) - 1 AS seq FROM fx_rollouts""", R)
def q_epoch_shuffle(spark, sf):
    d = bt.epoch_shuffle(fx.fx_rollouts(spark, sf), "sample_id", seed=42, epoch=3, out="seq")
    return d.select("sample_id", "seq")


@query("sample_n", f"""
SELECT doc_id FROM documents ORDER BY {_H.format(seed=7, col='doc_id')}, doc_id LIMIT 100""")
def q_sample_n(spark, sf):
    return bt.sample_n(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, seed=7)


@query("keep_last_n", _SEQ + """
SELECT sample_id FROM s WHERE seq >= (SELECT count(*) FROM s) - 500""", R)
def q_keep_last_n(spark, sf):
    return bt.keep_last_n(fx.fx_rollouts(spark, sf), 500, seq_col="sample_id").select("sample_id")


@query("restore_order", f"""
, p AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS seq,
          row_number() OVER (ORDER BY {_H.format(seed=1, col='sample_id')}, sample_id) - 1 AS shuffled FROM fx_rollouts)
SELECT shuffled AS "index", seq AS pos, sample_id FROM p""", R)
def q_restore_order(spark, sf):
    """A shuffled batch carries (position, original index); swapping the
    two gives the gather order back."""
    d = bt.epoch_shuffle(_seq(spark, sf), "sample_id", seed=0, epoch=1, out="shuffled")
    carried = d.select("sample_id", F.col("shuffled").alias("_seq"), F.col("_seq").alias("index"))
    back = bt.inverse_permutation(carried, "index", "_seq")
    return back.select(F.col("index"), F.col("_seq").alias("pos"), "sample_id")


@query("plan_offset", _SEQ + """
SELECT sample_id, seq % 64 + (seq // 64) * 64 AS global_pos FROM s""", R)
def q_plan_offset(spark, sf):
    d = _seq(spark, sf)
    return d.select("sample_id", bt.plan_offset(F.col("_seq") % STEP, F.floor(F.col("_seq") / STEP).cast("long"),
                                                STEP).alias("global_pos"))


@query("packed_offsets", """
, l AS (SELECT sample_id, count(*) AS length FROM fx_tokens GROUP BY sample_id),
o AS (SELECT *, sum(length) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS "offset" FROM l),
x AS (SELECT sample_id, "offset", length, greatest("offset", 1000) AS lo, least("offset" + length, 1100) AS hi FROM o)
SELECT sample_id, unnest(range(CAST(lo - "offset" AS BIGINT), CAST(hi - "offset" AS BIGINT))) AS position_id FROM x WHERE hi > lo""", T)
def q_packed_offsets(spark, sf):
    l = fx.fx_tokens(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("length"))
    o = bt.packed_offsets(l, "length", order_col="sample_id")
    return bt.slice_positions(o, 1000, 1100).select("sample_id", "position_id")


@query("pack_unpack", """
, l AS (SELECT sample_id, count(*) AS length FROM fx_tokens GROUP BY sample_id),
o AS (SELECT *, sum(length) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS "offset" FROM l)
SELECT t.sample_id, t.t, o."offset" + t.t AS stream_pos FROM fx_tokens t JOIN o USING (sample_id)""", T)
def q_pack_unpack(spark, sf):
    t = fx.fx_tokens(spark, sf)
    l = t.groupBy("sample_id").agg(F.count(F.lit(1)).alias("length"))
    o = bt.packed_offsets(l, "length", order_col="sample_id")
    return bt.pack(t, "sample_id", "t", o).select("sample_id", "t", F.col("stream_pos").cast("long").alias("stream_pos"))


@query("unpack", """
, u AS (SELECT sample_id, sample_id // 8 AS b, list(CAST(round(-log_prob * 10) AS INT) ORDER BY t) AS v FROM fx_tokens GROUP BY sample_id)
SELECT sample_id, list_resize(v, max(len(v)) OVER (PARTITION BY b), 0) AS ids FROM u""", T)
def q_unpack(spark, sf):
    t = fx.fx_tokens(spark, sf).withColumn("id", F.round(-F.col("log_prob") * 10).cast("int"))
    l = t.groupBy("sample_id").agg(F.count(F.lit(1)).alias("length"))
    o = bt.packed_offsets(l, "length", order_col="sample_id")
    stream = bt.pack(t, "sample_id", "t", o)
    u = bt.unpack(stream, "sample_id", "t", "id").withColumn("batch_id", F.floor(F.col("sample_id") / 8))
    return sft.pad_sequences(u, {"values": 0}).select("sample_id", F.col("values").alias("ids"))


@query("pad_to_multiple_slice", """
, a AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\\w+'), lambda x: CAST(length(x) AS INT)) AS ids FROM conversations),
b AS (SELECT *, CAST(ceil(len(ids) / 3.0) AS BIGINT) AS L FROM a),
c AS (SELECT *, list_concat(ids, list_transform(range(L * 3 - len(ids)), lambda i: 0)) AS padded FROM b)
SELECT conv_id, turn, array_to_string(padded[L + 1:2 * L], ',') AS slice FROM c""")
def q_pad_to_multiple_slice(spark, sf):
    c = table(spark, sf, "conversations")
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))
    d = c.select("conv_id", "turn", ids.alias("ids"))
    return d.select("conv_id", "turn", F.array_join(sft.pad_to_multiple_slice(F.col("ids"), 3, 1), ",").alias("slice"))


@query("seqlen_unbalance", _SEQ + """,
n AS (SELECT count(*) AS n FROM s),
c AS (SELECT seq // (n.n // 8) AS chunk, response_length FROM s, n),
g AS (SELECT chunk, sum(response_length) AS sm FROM c GROUP BY chunk)
SELECT 'contiguous' AS kind, CAST(min(sm) AS BIGINT) AS min_sum, CAST(max(sm) AS BIGINT) AS max_sum,
  CAST(max(sm) - min(sm) AS BIGINT) AS diff, round((SELECT sum(response_length) FROM s) / 8.0e0, 6) AS mean_sum FROM g""", R)
def q_seqlen_unbalance(spark, sf):
    d = met.seqlen_unbalance(_seq(spark, sf), 8, len_col="response_length")
    return d.select("kind", F.col("min_sum").cast("long").alias("min_sum"), F.col("max_sum").cast("long").alias("max_sum"),
                    F.col("diff").cast("long").alias("diff"), rnd("mean_sum").alias("mean_sum"))


@query("regroup_by_prompt", f"""
, p AS (SELECT *, row_number() OVER (ORDER BY {_H.format(seed=5, col='sample_id')}, sample_id) - 1 AS seq FROM fx_rollouts)
SELECT sample_id, seq, min(seq) OVER (PARTITION BY group_id) AS group_order FROM p""", R)
def q_regroup_by_prompt(spark, sf):
    d = bt.epoch_shuffle(fx.fx_rollouts(spark, sf), "sample_id", seed=5, epoch=0, out="_seq")
    return bt.regroup_by_prompt(d, "group_id").select("sample_id", F.col("_seq").alias("seq"), "group_order")


_WL = "list_transform(regexp_extract_all(text, '\\w+'), lambda x: CAST(length(x) AS INT))"


def _wl():
    return F.transform(F.regexp_extract_all("text", F.lit(r"\w+"), 0), lambda x: F.length(x).cast("int"))


@query("merge_batches", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids, length(text) AS n_chars, NULL AS n_words, conv_id // 4 AS batch_id FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, {_WL} AS ids, NULL AS n_chars, len(regexp_extract_all(text, '\\w+')) AS n_words, conv_id // 4 AS batch_id FROM conversations WHERE role <> 'user'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS L FROM u)
SELECT conv_id, turn, CAST(L AS INT) AS width, CAST(L - len(ids) AS INT) AS n_pad, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS INT) AS n_words FROM w""")
def q_merge_batches(spark, sf):
    c = table(spark, sf, "conversations")
    bid = (F.col("conv_id") / 4).cast("long").alias("batch_id")
    a = c.filter(F.col("role") == "user").select("conv_id", "turn", _wl().alias("ids"),
                                                 F.length("text").cast("long").alias("n_chars"), bid)
    b = c.filter(F.col("role") != "user").select("conv_id", "turn", _wl().alias("ids"),
                                                 F.size(F.regexp_extract_all("text", F.lit(r"\w+"), 0)).alias("n_words"), bid)
    m = bt.merge_batches([a, b], {"ids": 0})
    # word lengths are >= 1, so zeros are exactly the padding
    return m.select("conv_id", "turn", F.size("ids").alias("width"),
                    F.size(F.filter("ids", lambda x: x == 0)).alias("n_pad"), "n_chars", "n_words")


@query("collate_info", """
SELECT conv_id // 4 AS batch_id, list(role ORDER BY conv_id, turn) AS roles, list(turn ORDER BY conv_id, turn) AS turns
FROM conversations GROUP BY conv_id // 4""")
def q_collate_info(spark, sf):
    c = table(spark, sf, "conversations").withColumn("batch_id", (F.col("conv_id") / 4).cast("long"))
    c = c.withColumn("_seq", F.col("conv_id") * 1000 + F.col("turn"))
    return bt.collate_info(c, "batch_id", ["role", "turn"]).select("batch_id", F.col("role").alias("roles"),
                                                                    F.col("turn").alias("turns"))


@query("collate_typed_info", """
, e AS (SELECT event_id // 4 AS batch_id, event_id, replace(props, '}', CASE event_type
    WHEN 'error' THEN ', "score": "low"}' WHEN 'view' THEN '}' ELSE ', "score": ' || CAST(value AS VARCHAR) || '}' END) AS info FROM events),
x AS (SELECT batch_id, event_id, key, json_type(info, '$."' || key || '"') AS jt, json_extract_string(info, '$."' || key || '"') AS v
  FROM (SELECT *, unnest(json_keys(info)) AS key FROM e)),
y AS (SELECT *, CASE WHEN jt IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN jt = 'DOUBLE' THEN 'float' ELSE 'str' END AS kind FROM x),
n AS (SELECT batch_id, count(*) AS n, min(event_id) AS first FROM e GROUP BY batch_id),
g AS (SELECT batch_id, key, count(*) AS c, min(event_id) AS o, arg_min(kind, event_id) AS kind, count(DISTINCT kind) AS kinds,
    string_agg(DISTINCT kind, ', ' ORDER BY kind) AS told, string_agg(CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR), ',' ORDER BY event_id) AS nums,
    string_agg('"' || v || '"', ',' ORDER BY event_id) AS strs FROM y GROUP BY batch_id, key)
SELECT g.batch_id, key, kind, CASE WHEN c = n AND kinds = 1 THEN CASE WHEN kind = 'str' THEN strs ELSE nums END END AS vals,
  CASE WHEN c < n THEN 'missing in ' || (n - c) || ' rows' WHEN kinds > 1 THEN 'inconsistent types: ' || told END AS error
FROM g JOIN n ON n.batch_id = g.batch_id AND o = first""")
def q_collate_typed_info(spark, sf):
    """A22 with its type check: four events to a batch; scores are numbers, words or missing."""
    score = (F.when(F.col("event_type") == "error", ', "score": "low"}').when(F.col("event_type") == "view", "}")
             .otherwise(F.concat(F.lit(', "score": '), F.col("value").cast("string"), F.lit("}"))))
    e = table(spark, sf, "events").select((F.col("event_id") / 4).cast("long").alias("batch_id"), "event_id",
                                          F.replace("props", F.lit("}"), score).alias("info"))
    d = bt.collate_typed_info(e, "batch_id", "event_id", "info")
    return d.select("batch_id", "key", "kind", F.array_join(F.coalesce(F.col("numbers").cast("array<string>"), "texts"), ",").alias("vals"), "error")


@query("all_gather", _SEQ + """,
p AS (SELECT sample_id, CAST(seq % 7 AS INT) AS rank, seq // 7 AS local_idx,
        CAST(ceil((SELECT count(*) FROM s) / 7.0) AS BIGINT) AS ns FROM s)
SELECT sample_id, rank * ns + local_idx AS gathered_pos FROM p""", R)
def q_all_gather(spark, sf):
    """Per-rank shards (K1, no padding rows here) concatenated in rank order."""
    d = bt.rank_shard(_seq(spark, sf), 7)
    d = d.filter(F.col("_seq") == F.col("local_idx") * 7 + F.col("rank"))  # the original copies, not the wrap-around
    ns = F.ceil(F.col("__n") / F.lit(7)).cast("long")
    return d.select("sample_id", (F.col("rank") * ns + F.col("local_idx")).alias("gathered_pos"))


@query("select_fields", """
SELECT doc_id, lang FROM documents""")
def q_select_fields(spark, sf):
    d = table(spark, sf, "documents")
    fields = ["doc_id", "lang", "not_a_column"]
    return d.select(*[c for c in fields if c in d.columns])


@query("strip_padding", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids, conv_id // 4 AS batch_id FROM conversations),
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS L FROM a)
SELECT conv_id, turn, array_to_string(ids, ',') AS stripped, array_to_string(ids, ',') AS right_stripped FROM b""")
def q_strip_padding(spark, sf):
    """Pad to the batch width with an attention mask, then strip."""
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wl().alias("ids"), (F.col("conv_id") / 4).cast("long").alias("batch_id"))
    d = d.withColumn("mask", F.array_repeat(F.lit(1), F.size("ids")))
    p = sft.pad_sequences(d, {"ids": 0, "mask": 0})
    return p.select("conv_id", "turn", F.array_join(sft.strip_padding(F.col("ids"), F.col("mask")), ",").alias("stripped"),
                    F.array_join(sft.strip_right_padding(F.col("ids"), F.col("mask")), ",").alias("right_stripped"))


@query("row_explode", """
, a AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, turns, CASE WHEN conv_id % 7 = 0 THEN roles[2:] ELSE roles END AS roles FROM a)
SELECT conv_id, CAST(unnest(range(len(turns))) AS INTEGER) AS pos, unnest(turns) AS turn, unnest(roles) AS role, NULL AS error FROM b WHERE len(turns) = len(roles)
UNION ALL SELECT conv_id, NULL, NULL, NULL, 'turn: ' || len(turns) || ', role: ' || len(roles) FROM b WHERE len(turns) <> len(roles)""")
def q_row_explode(spark, sf):
    """P25: batch arrays to rows; every seventh conversation lacks a role and is quarantined."""
    c = table(spark, sf, "conversations")
    a = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    roles = F.transform("x", lambda e: e["role"])
    short = F.slice(roles, 2, F.greatest(F.size("x") - 1, F.lit(0)))
    a = a.select("conv_id", F.transform("x", lambda e: e["turn"]).alias("turn"), F.when(F.col("conv_id") % 7 == 0, short).otherwise(roles).alias("role"))
    return bt.row_explode(a, ["turn", "role"], ["conv_id"])


@query("merge_experiences", f"""
, t AS (SELECT conv_id, turn, role, {_WL} AS ids, length(text) AS n FROM conversations),
w AS (SELECT conv_id // 4 AS batch_id, max(len(ids)) AS L FROM t GROUP BY conv_id // 4),
p AS (SELECT conv_id // 4 AS batch_id, conv_id, turn, role, n,
    array_to_string(list_concat(ids, list_transform(range(L - len(ids)), lambda i: 77)), ',') AS seq,
    array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(L - len(ids)), lambda i: 0)), ',') AS mask
  FROM t JOIN w ON w.batch_id = t.conv_id // 4),
k AS (SELECT batch_id, role, role || '=' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY conv_id, turn) AS kv FROM p GROUP BY batch_id, role),
m AS (SELECT batch_id, string_agg(kv, ';' ORDER BY role) AS info FROM k GROUP BY batch_id)
SELECT batch_id, string_agg(seq, ';' ORDER BY conv_id, turn) AS sequences, string_agg(mask, ';' ORDER BY conv_id, turn) AS masks,
  string_agg(role, ',' ORDER BY conv_id, turn) AS roles, any_value(info) AS info FROM p JOIN m USING (batch_id) GROUP BY batch_id""")
def q_merge_experiences(spark, sf):
    """Conversations as small batches, four merged to one: sequences padded with
    their own value, roles appended, info lists merged by key."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", _wl().alias("ids"), F.length("text").alias("n"))
    info = (t.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("x"))
            .groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", F.transform("x", lambda e: e["n"])))).alias("info")))
    b = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids"))).alias("x")).join(info, "conv_id")
    b = b.select("conv_id", (F.col("conv_id") / 4).cast("long").alias("batch_id"), F.transform("x", lambda e: e["ids"]).alias("sequences"),
                 F.transform("x", lambda e: F.transform(e["ids"], lambda v: F.lit(1))).alias("masks"), F.transform("x", lambda e: e["role"]).alias("roles"), "info")
    m = bt.merge_experiences(b, "batch_id", "conv_id", pad={"sequences": 77, "masks": 0}, lists=("roles",), maps=("info",))
    text = F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"].cast("array<string>"), ",")))
    return m.select("batch_id", *(F.array_join(F.transform(c, lambda r: F.array_join(r.cast("array<string>"), ",")), ";").alias(c) for c in ("sequences", "masks")),
                    F.array_join("roles", ",").alias("roles"), F.array_join(text, ";").alias("info"))


@query("exists_not_null", """
SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.z') IS NOT NULL AS has_z FROM events""")
def q_exists_not_null(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"),
                    F.get_json_object("props", "$.z").isNotNull().alias("has_z"))


# ---- sequential planners: first fit and greedy against recursive CTEs; for the sets
# of the differencing method, invariants of each step

def _steps(spark, sf):
    d = _seq(spark, sf).withColumn("step", F.floor(F.col("_seq") / STEP).cast("long"))
    return d.withColumn("total_length", F.col("response_length") + 20)


# rows of each step in order: x is the length, i the position in the step
_ITEMS = _SEQ + f""", it AS (SELECT seq // {STEP} AS step, CAST(seq % {STEP} AS BIGINT) AS i, CAST(response_length + 20 AS BIGINT) AS x, sample_id FROM s)"""


def _first_fit_sql(items: str, keys: str, budget: int) -> str:
    """Bins of first fit per group of ``items`` (keys, i, x): ``ff`` (keys, bins)."""
    own = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"n.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""ffr AS (
  SELECT {keys}, i, [x] AS bins FROM {items} WHERE i = 0
  UNION ALL
  SELECT {own}, n.i, CASE WHEN list_position(list_transform(r.bins, lambda b: b + n.x <= {budget}), true) IS NULL THEN list_append(r.bins, n.x)
    ELSE list_transform(r.bins, lambda b, j: CASE WHEN j = list_position(list_transform(r.bins, lambda c: c + n.x <= {budget}), true) THEN b + n.x ELSE b END) END
  FROM ffr r JOIN {items} n ON {same} AND n.i = r.i + 1),
ff AS (SELECT {keys}, arg_max(bins, i) AS bins FROM ffr GROUP BY {keys})"""


@query("first_fit_count", _ITEMS + "," + _first_fit_sql("it", "step", 2000) + """
SELECT step, CAST(len(bins) AS INT) AS n_bins, list_max(bins) AS max_bin FROM ff""", R, recursive=True)
def q_first_fit_count(spark, sf):
    return bt.first_fit_count(_steps(spark, sf), 2000, "step")


@query("balanced_partitions")
def q_balanced_partitions(spark, sf):
    return bt.balanced_partitions(_steps(spark, sf), 4, "step")


@query("balanced_partitions_equal")
def q_balanced_partitions_equal(spark, sf):
    return bt.balanced_partitions(_steps(spark, sf), 4, "step", equal_size=True)


def _set_facts(plan, keys, set_col, len_col="x"):
    """Per step: rows, sets, smallest and largest set, and whether the totals of two
    sets differ by no more than the longest item."""
    per = plan.groupBy(*keys, set_col).agg(F.count(F.lit(1)).alias("c"), F.sum(len_col).alias("t"), F.max(len_col).alias("m"))
    return per.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_sets"), F.sum("t").cast("long").alias("total"),
                                  (F.max("t") - F.min("t") <= F.max("m")).alias("spread_ok"),
                                  (F.max("c") - F.min("c")).alias("size_gap"))


def _lengths(d):
    return d.select("sample_id", F.col("total_length").cast("long").alias("x"))


@query("balanced_partitions_check", _ITEMS + """
SELECT step, count(*) AS n, least(4, count(*)) AS n_sets, CAST(sum(x) AS BIGINT) AS total, true AS spread_ok, count(*) % 4 > 0 AS uneven FROM it GROUP BY step""", R)
def q_balanced_partitions_check(spark, sf):
    """K5: every row of a step is in one of its sets; the balanced form's set sizes
    differ by one at most."""
    d = _steps(spark, sf)
    lens = _lengths(d)
    free = _set_facts(bt.balanced_partitions(d, 4, "step").join(lens, "sample_id"), ["step"], "part")
    equal = _set_facts(bt.balanced_partitions(d, 4, "step", equal_size=True).join(lens, "sample_id"), ["step"], "part")
    gap = equal.select("step", (F.col("size_gap") == 1).alias("uneven"))
    return free.join(gap, "step").select("step", "n", "n_sets", "total", "spread_ok", "uneven")


@query("least_loaded_partition", _ITEMS + """,
g AS (
  SELECT step, i, sample_id, [x, 0, 0, 0] AS sums, 0 AS part FROM it WHERE i = 0
  UNION ALL
  SELECT g.step, n.i, n.sample_id,
    list_transform(g.sums, lambda v, j: CASE WHEN j = list_position(g.sums, list_min(g.sums)) THEN v + n.x ELSE v END),
    CAST(list_position(g.sums, list_min(g.sums)) - 1 AS INT)
  FROM g JOIN it n ON n.step = g.step AND n.i = g.i + 1)
SELECT step, part, sample_id FROM g""", R, recursive=True)
def q_least_loaded_partition(spark, sf):
    return bt.balanced_partitions(_steps(spark, sf), 4, "step", method="greedy")


def _ranks(spark, sf):
    d = _seq(spark, sf).withColumn("total_length", F.col("response_length") + 20)
    d = d.withColumn("dp_rank", (F.col("_seq") % 2).cast("long"))
    return d.withColumn("_seq", F.floor(F.col("_seq") / 2).cast("long"))


@query("micro_batch_plan")
def q_micro_batch_plan(spark, sf):
    return bt.micro_batch_plan(_ranks(spark, sf), STEP, 3000, rank_col="dp_rank")


@query("micro_batch_plan_check", _SEQ + f""",
it AS (SELECT (seq // 2) // {STEP} AS step, CAST(seq % 2 AS BIGINT) AS dp_rank, CAST((seq // 2) % {STEP} AS BIGINT) AS i, CAST(response_length + 20 AS BIGINT) AS x FROM s),
""" + _first_fit_sql("it", "step, dp_rank", 3000) + """,
k AS (SELECT step, max(len(bins)) AS n_micro FROM ff GROUP BY step)
SELECT it.step, dp_rank, CAST(max(n_micro) AS INT) AS n_micro, count(*) AS n, least(count(*), max(n_micro)) AS n_sets, CAST(sum(x) AS BIGINT) AS total,
  true AS spread_ok, 1.0e0 AS scale_sum, CAST(1 AS BIGINT) AS n_optimizer FROM it JOIN k ON it.step = k.step GROUP BY it.step, dp_rank""", R, recursive=True)
def q_micro_batch_plan_check(spark, sf):
    """K7: the micro-batch count is the largest first-fit count of the ranks; the
    loss scales of a rank's step add up to 1 and one micro-batch steps."""
    d = _ranks(spark, sf)
    plan = bt.micro_batch_plan(d, STEP, 3000, rank_col="dp_rank").join(_lengths(d), "sample_id")
    keys = ["step", "dp_rank"]
    per = plan.groupBy(*keys, "micro_batch").agg(F.max("loss_scale").alias("s"), F.max("optimizer_step").alias("o"), F.max("n_micro").alias("n_micro"))
    sums = per.groupBy(*keys).agg(rnd(F.sum("s")).alias("scale_sum"), F.sum("o").alias("n_optimizer"), F.max("n_micro").alias("n_micro"))
    return _set_facts(plan, keys, "micro_batch").drop("size_gap").join(sums, keys)


def _rollout_steps(spark, sf):
    return _steps(spark, sf).withColumn("rollout_step", F.floor(F.col("_seq") / 512).cast("long"))


@query("rollout_batch_count")
def q_rollout_batch_count(spark, sf):
    return bt.rollout_batch_plan(_rollout_steps(spark, sf), actors=4, max_tokens=8000)


@query("rollout_batch_check", _SEQ + """,
it AS (SELECT seq // 512 AS rollout_step, CAST(seq % 512 AS BIGINT) AS i, CAST(response_length + 20 AS BIGINT) AS x FROM s),
""" + _first_fit_sql("it", "rollout_step", 8000) + """
SELECT it.rollout_step, CAST(greatest(max(len(bins)) // 4 * 4, 4) AS INT) AS n_batches, count(*) AS n,
  least(count(*), greatest(max(len(bins)) // 4 * 4, 4)) AS n_sets, CAST(sum(x) AS BIGINT) AS total, true AS spread_ok
FROM it JOIN ff ON it.rollout_step = ff.rollout_step GROUP BY it.rollout_step""", R, recursive=True)
def q_rollout_batch_check(spark, sf):
    """K8: the batch count follows first fit; every row is in a batch."""
    d = _rollout_steps(spark, sf)
    plan = bt.rollout_batch_plan(d, actors=4, max_tokens=8000).join(_lengths(d), "sample_id")
    count = plan.groupBy("rollout_step").agg(F.max("n_batches").alias("n_batches"))
    return _set_facts(plan, ["rollout_step"], "batch").drop("size_gap").join(count, "rollout_step")


@query("strip_right_padding", f"""
, a AS (SELECT conv_id, turn, {_WL} AS ids FROM conversations)
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n FROM a""")
def q_strip_right_padding(spark, sf):
    """Every per-token column cut by the right-pad length of the mask."""
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", _wl().alias("ids"), (F.col("conv_id") / 4).cast("long").alias("batch_id"))
    d = d.withColumn("mask", F.array_repeat(F.lit(1), F.size("ids")))
    p = sft.pad_sequences(d, {"ids": 0, "mask": 0})
    return p.select("conv_id", "turn", F.size(sft.strip_right_padding(F.col("ids"), F.col("mask"))).alias("n"))


@query("seqlen_unbalance_balanced")
def q_seqlen_unbalance_balanced(spark, sf):
    """A13 per training step: min / max / diff of the contiguous chunk sums
    and of the balanced (largest differencing) partition sums, and the mean
    total / k. Rows-only: the partitions come from the K5 planner."""
    k = 4
    d = _steps(spark, sf).select("step", "_seq", "sample_id", "total_length")
    parts = bt.balanced_partitions(d, k, "step").select("sample_id", "part")
    w = F.floor((F.col("_seq") - F.col("step") * STEP) / F.lit(STEP // k)).cast("long")
    d = d.join(parts, "sample_id").withColumn("chunk", w)
    contiguous = d.groupBy("step", "chunk").agg(F.sum("total_length").alias("s")).groupBy("step").agg(
        F.min("s").alias("min_sum"), F.max("s").alias("max_sum"))
    balanced = d.groupBy("step", "part").agg(F.sum("total_length").alias("s")).groupBy("step").agg(
        F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"),
        (F.sum("s") / F.lit(float(k))).alias("mean_sum"))
    out = contiguous.join(balanced, "step")
    return out.select("step", "min_sum", "max_sum", (F.col("max_sum") - F.col("min_sum")).alias("minmax_diff"),
                      "balanced_min", "balanced_max", rnd("mean_sum").alias("mean_sum"))
