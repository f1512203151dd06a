"""Prompt and chat shaping for SFT and RL prompts.

Chat rows are one row per turn ``(conv_id, turn, role, text)``. Per-turn work
(rendering, tokenizing, prefix lengths) is columnar; windows are partitioned by
conversation (bounded by its number of turns); the only per-conversation
collection is the final ordered concatenation of token arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttrain.functions import text as tx

IGNORE_INDEX = -100
# fixed value: the think-block pattern whose labels are zeroed (P9) and its token count (P5)
THINK_PATTERN = (151667, 271, 151668, 271)
THINK_TOKENS = 4

Tokenizer = Callable[[Column], Column]


def expand_n_samples(prompts: DataFrame, n: int, out: str = "sample_idx") -> DataFrame:
    """Repeat every prompt row ``n`` times (copies adjacent by sample_idx)."""
    return prompts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(out))


def render_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", add_generation_prompt: bool = True,
                out: str = "prompt_text") -> DataFrame:
    """Chat turns -> one prompt string per conversation (ChatML-style
    markers), turns in order, generation prompt appended. The per-conversation
    list is bounded by the number of turns."""
    per = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("t"), tx.render_turn(F.col(role_col), F.col(text_col)).alias("s")))).alias("__a"))
    body = F.array_join(F.transform("__a", lambda e: e["s"]), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(tx.GENERATION_PROMPT))
    return per.select(conv_col, body.alias(out))


def messages_to_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """P1 + explode: ``messages`` else ``message`` (array of role/content
    structs) -> one row per turn."""
    cols = df.columns
    if "messages" in cols and "message" in cols:
        msgs = F.coalesce(F.col("messages"), F.col("message"))
    else:
        msgs = F.col("messages" if "messages" in cols else "message")
    return df.select(id_col, F.posexplode(msgs).alias("turn", "m")).select(
        id_col, F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("text"))


def drop_system_turns(turns: DataFrame, role_col: str = "role") -> DataFrame:
    """Remove system turns, order kept."""
    return turns.filter(F.col(role_col).isNull() | (F.col(role_col) != "system"))


def turn_prefix_lengths(turns: DataFrame, tokenizer: Tokenizer = tx.tokenize, conv_col: str = "conv_id",
                        turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                        last_assistant_only: bool = False, think_offset: bool = False) -> DataFrame:
    """Per turn, the token ids it adds, the template prefix length
    up to it (system/user prefixes include the generation prompt), the running
    cursor and the number of labels it emits.

    The cursor only moves when a turn adds tokens, so it is the running max of
    earlier prefix lengths: new = prefix - max(prefix of earlier turns, 0);
    a turn with new <= 0 adds no labels."""
    gen = F.size(tokenizer(F.lit(tx.GENERATION_PROMPT)))
    wc = Window.partitionBy(conv_col)
    wo = wc.orderBy(turn_col)
    d = turns.withColumn("ids", tokenizer(tx.render_turn(F.col(role_col), F.col(text_col))))
    d = d.withColumn("n_tok", F.size("ids"))
    d = d.withColumn("__idx", F.row_number().over(wo) - 1)
    d = d.withColumn("last_asst", F.coalesce(F.max(F.when(F.col(role_col) == "assistant", F.col("__idx"))).over(wc),
                                             F.lit(-1)))
    prefix = F.sum("n_tok").over(wo.rowsBetween(Window.unboundedPreceding, 0)) + F.when(
        F.col(role_col).isin("system", "user"), gen).otherwise(F.lit(0))
    if think_offset:
        prefix = prefix - F.when((F.col(role_col) == "assistant") & (F.col("__idx") != F.col("last_asst"))
                                 & (F.col("last_asst") > 2), F.lit(THINK_TOKENS)).otherwise(F.lit(0))
    d = d.withColumn("prefix_len", prefix)
    d = d.withColumn("cursor", F.coalesce(F.max("prefix_len").over(wo.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))
    d = d.withColumn("new_tokens", F.greatest(F.col("prefix_len") - F.col("cursor"), F.lit(0)))
    bit = F.col(role_col) == "assistant"
    if last_assistant_only:
        bit = bit & (F.col("__idx") == F.col("last_asst"))
    return d.withColumn("bit", bit.cast("int")).drop("__idx")


def pattern_zero(df: DataFrame, ids_col: str, labels_col: str,
                 pattern: tuple[int, ...] = THINK_PATTERN) -> DataFrame:
    """Labels set to 0 on every occurrence of ``pattern`` in ids. The
    match starts are materialised once per row, then each label position
    checks them (no per-element re-scan of the ids)."""
    k = len(pattern)
    pat = F.array(*[F.lit(int(p)) for p in pattern])
    ids = F.col(ids_col)
    n = F.size(ids)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                      lambda i: (i <= n - k + 1) & (F.slice(ids, i, k) == pat))
    d = df.withColumn("__starts", starts)
    # __starts is read twice here, so the optimizer keeps it a materialised
    # column instead of inlining the scan into the per-element lambda
    zeroed = F.when(F.size("__starts") == 0, F.col(labels_col)).otherwise(F.transform(labels_col, lambda x, i: F.when(
        F.exists("__starts", lambda s: (i + 1 >= s) & (i + 1 < s + k)), F.lit(0)).otherwise(x)))
    return d.withColumn(labels_col, zeroed).drop("__starts")


def shape_chat(turns: DataFrame, max_length: int, tokenizer: Tokenizer = tx.tokenize,
               conv_col: str = "conv_id", drop_system: bool = False, last_assistant_only: bool = False,
               think_offset: bool = False, zero_pattern: tuple[int, ...] | None = None) -> DataFrame:
    """Chat template mode. One row per conversation with
    ``input_ids``, ``attention_mask``, ``target_mask`` truncated to
    ``max_length``; a length mismatch quarantines the row (all three null,
    ``error`` set) instead of failing the job."""
    t = drop_system_turns(turns) if drop_system else turns
    d = turn_prefix_lengths(t, tokenizer, conv_col, last_assistant_only=last_assistant_only,
                            think_offset=think_offset)
    per = d.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("t"), F.col("ids").alias("ids"),
        F.array_repeat(F.col("bit"), F.col("new_tokens").cast("int")).alias("lab")))).alias("__a"))
    ids = F.slice(F.flatten(F.transform("__a", lambda e: e["ids"])), 1, max_length)
    lab = F.slice(F.flatten(F.transform("__a", lambda e: e["lab"])), 1, max_length)
    per = per.select(conv_col, ids.alias("__ids"), lab.alias("__lab"))
    ok = F.size("__ids") == F.size("__lab")
    if zero_pattern:
        per = pattern_zero(per, "__ids", "__lab", zero_pattern)
    lab_c = F.col("__lab")
    return per.select(
        conv_col,
        F.when(ok, F.col("__ids")).alias("input_ids"),
        F.when(ok, F.array_repeat(F.lit(1), F.size("__ids"))).alias("attention_mask"),
        F.when(ok, lab_c).alias("target_mask"),
        F.when(~ok, F.lit("length mismatch")).alias("error"))


def shape_concat(turns: DataFrame, tokenizer: Tokenizer = tx.tokenize, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """No template: concatenate the tokens of each content, mask 1 on
    assistant content; not truncated here (the collator truncates)."""
    d = turns.select(conv_col, turn_col, tokenizer(F.col(text_col)).alias("ids"),
                     (F.col(role_col) == "assistant").cast("int").alias("bit"))
    per = d.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("t"), "ids", F.array_repeat("bit", F.size("ids")).alias("lab")))).alias("__a"))
    ids = F.flatten(F.transform("__a", lambda e: e["ids"]))
    return per.select(conv_col, ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
                      F.flatten(F.transform("__a", lambda e: e["lab"])).alias("target_mask"))


def ignore_labels(ids: Column, mask: Column) -> Column:
    """P10: labels = id where mask is 1, else -100."""
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE_INDEX)))


def pad_label_ignore(ids: Column, pad_id: int) -> Column:
    """labels = -100 where the id is the pad id."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def pad_to(arr: Column, length: Column, value, left: bool = False) -> Column:
    """K9 building block: pad ``arr`` with ``value`` up to ``length``."""
    pad = F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0)))
    return F.concat(pad, arr) if left else F.concat(arr, pad)


def pad_sequences(df: DataFrame, cols: dict[str, object], batch_col: str = "batch_id",
                  left: bool = False) -> DataFrame:
    """K9: pad every array column to its own longest in the batch (window max over
    the batch, bounded by the batch size); a null array is empty."""
    w = Window.partitionBy(batch_col)
    widths = {f"__L{i}": F.max(F.coalesce(F.size(c), F.lit(0))).over(w) for i, c in enumerate(cols)}
    d = df.withColumns(widths)
    d = d.withColumns({c: pad_to(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), F.col(f"__L{i}"), v, left)
                       for i, (c, v) in enumerate(cols.items())})
    return d.drop(*widths)


def sft_collate(rows: DataFrame, max_length: int, pad_id: int, batch_col: str = "batch_id") -> DataFrame:
    """Batch target length = min(max_length, longest valid row), 1 for a
    batch of only null rows; null rows become all-pad; pad, truncate, then
    labels = id where target_mask = 1 else -100."""
    w = Window.partitionBy(batch_col)
    empty = F.array().cast("array<int>")
    d = rows.withColumn("__L", F.coalesce(F.least(F.max(F.size("input_ids")).over(w), F.lit(max_length)), F.lit(1)))
    ids = F.slice(pad_to(F.coalesce("input_ids", empty), F.col("__L"), pad_id), 1, max_length)
    att = F.slice(pad_to(F.coalesce("attention_mask", empty), F.col("__L"), 0), 1, max_length)
    tm = F.slice(pad_to(F.coalesce("target_mask", empty), F.col("__L"), 0), 1, max_length)
    d = d.withColumn("input_ids", ids).withColumn("attention_mask", att).withColumn("__tm", tm)
    return d.withColumn("labels", ignore_labels(F.col("input_ids"), F.col("__tm"))).drop("__L", "__tm", "target_mask")


def build_prompt(prompt: Column, template: str | None = None, apply_chat_template: bool = True) -> Column:
    """A prompt string as one user turn rendered with the generation
    prompt, or ``template`` with ``{}`` replaced by the prompt."""
    if template is not None:
        i = template.index("{}")
        return F.concat(F.lit(template[:i]), prompt, F.lit(template[i + 2:]))
    if apply_chat_template:
        return F.concat(tx.render_turn(F.lit("user"), prompt), F.lit(tx.GENERATION_PROMPT))
    return prompt


def prompt_defaults(df: DataFrame, label_key: str | None, ds_col: str = "datasource") -> DataFrame:
    """Label '' when no label key is configured (or the value is null),
    datasource 'default' when missing."""
    label = F.coalesce(F.col(label_key), F.lit("")) if label_key and label_key in df.columns else F.lit("")
    ds = F.coalesce(F.col(ds_col), F.lit("default")) if ds_col in df.columns else F.lit("default")
    return df.withColumn("label", label).withColumn("datasource", ds)


def assemble_sample(prompt_ids: Column, response_ids: Column, truncate_length: int,
                    max_response_length: int) -> Column:
    """sequences = prompt ++ response cut at ``truncate_length``; action
    mask marks response positions, shifted by one (positions 1..truncate-1);
    total_length, response_length, is_clipped (response >= max)."""
    seq = F.concat(prompt_ids, response_ids)
    np_, nr = F.size(prompt_ids), F.size(response_ids)
    full_mask = F.concat(F.array_repeat(F.lit(0), np_), F.array_repeat(F.lit(1), nr))
    seq_t = F.slice(seq, 1, truncate_length)
    mask_t = F.slice(full_mask, 2, truncate_length - 1)
    return F.struct(seq_t.alias("sequences"), F.array_repeat(F.lit(1), F.size(seq_t)).alias("attention_mask"),
                    mask_t.alias("action_mask"), F.size(seq_t).alias("total_length"),
                    nr.alias("response_length"), (nr >= max_response_length).alias("is_clipped"),
                    np_.alias("prompt_token_len"))


def mask_from_ranges(n_tokens: Column, ranges: Column, limit: int) -> Column:
    """Action mask over positions 1..n-1 (shifted by one) with 1 inside
    any [start, end) span; response_length = last 1 - first 1 + 1 (0 if none);
    is_clipped = total >= limit."""
    mask = F.transform(F.sequence(F.lit(1), F.greatest(n_tokens - 1, F.lit(1))),
                       lambda p: F.when(F.exists(ranges, lambda r: (p >= r["start"]) & (p < r["end"])), 1).otherwise(0))
    mask = F.when(n_tokens > 1, mask).otherwise(F.array().cast("array<int>"))
    first = F.array_position(mask, 1)
    last = F.size(mask) - F.array_position(F.reverse(mask), 1) + 1
    rl = F.when(first == 0, F.lit(0)).otherwise(last - first + 1)
    return F.struct(mask.alias("action_mask"), rl.cast("int").alias("response_length"),
                    (n_tokens >= limit).alias("is_clipped"))


def strip_padding(values: Column, mask: Column) -> Column:
    """Keep positions where mask is 1."""
    return F.filter(F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))),
                    lambda e: e["m"] == 1).getField("v")


def right_pad_len(mask: Column) -> Column:
    """Number of trailing zeros of an attention mask."""
    pos = F.array_position(F.reverse(mask), 1)
    return F.when(pos == 0, F.size(mask)).otherwise(pos - 1)


def strip_right_padding(values: Column, mask: Column) -> Column:
    """Cut a per-token column by the right-pad length of the mask."""
    keep = F.size(values) - right_pad_len(mask)
    return F.when(keep > 0, F.slice(values, 1, F.greatest(keep, F.lit(1)))).otherwise(F.slice(values, 1, 0))


def pad_to_multiple_slice(ids: Column, multiple: int, rank: int, pad_id: int = 0) -> Column:
    """Right-pad to a multiple of ``multiple`` and take slice ``rank``."""
    n = F.size(ids)
    padded_len = ((n + multiple - 1) / multiple).cast("int") * multiple
    padded = pad_to(ids, padded_len, pad_id)
    L = (padded_len / multiple).cast("int")
    return F.slice(padded, L * rank + 1, L)


def truncate(arr: Column, max_length: int) -> Column:
    """First ``max_length`` elements."""
    return F.slice(arr, 1, max_length)
