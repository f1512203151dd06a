"""String and JSON column builders.

All are Catalyst expressions (regexp, higher-order array functions), so they
run inside whole-stage codegen with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fence language tags recognised by the single-language extractor
CODE_TAGS_LAST = ("python|go|ts|php|csharp|bash|javascript|cpp|cs|java|typescript|js|sh")
# fixed values: fence language tags recognised by the multi-language extractor
# (alternation order matters: the first alternative that matches wins)
CODE_TAGS_MULTI = ("python|go|rs|rust|ts|scala|d|r|php|csharp|bash|javascript|"
                   "cpp|cs|java|typescript|js|sh|julia|swift|perl|lua|rkt|racket|rb|ruby")
# fixed values: marker strings
NO_BLOCK = "raise"
NO_DEF_BLOCK = "none"
ANSWER_OPEN, ANSWER_CLOSE = "[ANSWER]", "[/ANSWER]"

_FENCE = "```"


def pystrip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind, Unicode
    included (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _blocks(text: Column, tags: str | None, optional: bool = False) -> Column:
    if tags is None:
        pat = r"(?s)```(?:python\s*)?([\s\S]*?)```"
    else:
        pat = rf"(?s)```(?:{tags}){'?' if optional else ''}(.*?)```"
    return F.regexp_extract_all(text, F.lit(pat), 1)


def extract_code_last(text: Column) -> Column:
    """Last fenced block with one of the single-language tags, stripped;
    ``'raise'`` when there is none."""
    last = F.try_element_at(_blocks(text, CODE_TAGS_LAST), F.lit(-1))
    return F.coalesce(pystrip(last), F.lit(NO_BLOCK))


def extract_code_multi(text: Column) -> Column:
    """Last block with one of the multi-language tags, stripped; falls back
    to the whole text stripped."""
    last = F.try_element_at(_blocks(text, CODE_TAGS_MULTI), F.lit(-1))
    return F.coalesce(pystrip(last), pystrip(text))


def extract_code_def(text: Column) -> Column:
    """Fences with an optional ``python`` tag; the last block containing
    ``def``, else the last block, else ``'none'``."""
    blocks = _blocks(text, None)
    with_def = F.filter(blocks, lambda b: b.contains("def"))
    pick = F.coalesce(F.try_element_at(with_def, F.lit(-1)), F.try_element_at(blocks, F.lit(-1)))
    return F.coalesce(pystrip(pick), F.lit(NO_DEF_BLOCK))


def extract_answer(text: Column) -> Column:
    """T4: last ``[ANSWER]..[/ANSWER]`` block stripped, else ``'raise'``."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)\[ANSWER\](.*?)\[/ANSWER\]"), 1)
    return F.coalesce(pystrip(F.try_element_at(blocks, F.lit(-1))), F.lit(NO_BLOCK))


def answer_gate(block: Column, score: Column) -> Column:
    """P20: score only answers that contain ``assert``; others get 0.0."""
    return F.when(block.contains("assert"), score).otherwise(F.lit(0.0))


def test_program(candidate: Column, test: Column) -> Column:
    """T5: candidate program followed by its test on a new line."""
    return F.concat(candidate, F.lit("\n"), test)


def guide_text(label: Column, prefix: str, suffix: str = "") -> Column:
    """Prefix + label + suffix; null (rejected) when it is blank."""
    g = F.concat(F.lit(prefix), F.coalesce(label, F.lit("")), F.lit(suffix))
    return F.when(F.length(pystrip(g)) > 0, g)


def parse_logprobs(resp_json: Column) -> Column:
    """From a completion response JSON take the first choice's
    ``token_logprobs``; drop the first entry when it is as long as ``tokens``
    (echoed prompt), then drop nulls. Empty list when absent."""
    schema = "struct<choices: array<struct<logprobs: struct<token_logprobs: array<double>, tokens: array<string>>>>>"
    p = F.from_json(resp_json, schema)
    first = F.try_element_at(p["choices"], F.lit(1))
    lps = F.coalesce(first["logprobs"]["token_logprobs"], F.array().cast("array<double>"))
    toks = F.coalesce(first["logprobs"]["tokens"], F.array().cast("array<string>"))
    shifted = F.when((F.size(toks) > 0) & (F.size(lps) == F.size(toks)) & (F.size(lps) > 0),
                     F.slice(lps, 2, F.greatest(F.size(lps) - 1, F.lit(0)))).otherwise(lps)
    return F.filter(shifted, lambda x: x.isNotNull())


def parse_ds_set(raw: Column) -> Column:
    """``all`` -> null (match everything), ``none``/empty -> empty array,
    else the comma list lower-cased and stripped, blanks dropped."""
    r = F.lower(pystrip(F.coalesce(raw, F.lit(""))))
    items = F.filter(F.transform(F.split(r, ","), lambda s: pystrip(s)), lambda s: s != "")
    return (F.when(r == "all", F.lit(None).cast("array<string>"))
            .when(r.isin("none", ""), F.array().cast("array<string>"))
            .otherwise(items))


def normalize_datasource(ds: Column, known: list[str], default: str) -> Column:
    """null/empty -> default, lower + strip, unknown -> default."""
    d = F.lower(pystrip(F.coalesce(F.nullif(ds, F.lit("")), F.lit(default))))
    return F.when(d.isin(*known), d).otherwise(F.lit(default))


def truncate_left(ids: Column, keep: Column | int) -> Column:
    """Keep the last ``keep`` elements."""
    k = F.lit(keep) if isinstance(keep, int) else keep
    return F.when(F.size(ids) <= k, ids).otherwise(F.slice(ids, F.size(ids) - k + 1, k))


# fixed values: ChatML-style markers of the chat renderer
CHAT_START, CHAT_END = "<|im_start|>", "<|im_end|>"
GENERATION_PROMPT = "<|im_start|>assistant\n"


def render_turn(role: Column, content: Column) -> Column:
    """One chat turn rendered as ``<|im_start|>role\\ncontent<|im_end|>\\n``."""
    return F.concat(F.lit(CHAT_START), role, F.lit("\n"), content, F.lit(CHAT_END + "\n"))


def tokenize(text: Column, vocab_size: int = 1 << 20) -> Column:
    """T12 default tokenizer: split on word / non-space runs and map each piece
    to a stable id (xxhash64 mod vocab). A real vocabulary plugs in through
    ``pandas_udf`` with the same signature."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s]+)"), 1)
    return F.transform(pieces, lambda p: F.pmod(F.xxhash64(p), F.lit(vocab_size)).cast("int"))
