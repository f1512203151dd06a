"""The Python plug-in surface.

User code (a reward function, a remote client) runs inside Spark tasks on
Arrow batches (``mapInPandas``): one call per batch, never per row, and
nothing is collected to the driver. Failures are contained per row, so one bad
item fails neither the job nor its neighbours."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RewardFunc = Callable[..., Mapping[str, Any]]

_REWARD_FIELDS = "reward double, score double, extra map<string,double>, teacher_log_probs array<double>, error string"


def load_reward_func(path: str, name: str = "reward_func") -> RewardFunc:
    """load ``reward_func(queries, prompts, labels, **kw)`` from a user
    Python file (the plug-in file is the caller's code)."""
    import importlib.util
    spec = importlib.util.spec_from_file_location("user_reward_module", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"cannot load reward module {path}")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return getattr(mod, name)


def apply_reward_func(df: DataFrame, reward_func: RewardFunc, query_col: str = "query",
                      prompt_col: str = "prompt", label_col: str = "label", ds_col: str | None = "datasource",
                      keep: tuple[str, ...] = (), query_token_ids_col: str | None = None,
                      prompt_token_lens_col: str | None = None) -> DataFrame:
    """call ``reward_func(queries, prompts, labels, datasources=...,
    query_token_ids=..., prompt_token_lens=...)`` on the rows of an Arrow batch; it
    returns ``rewards`` and optionally ``scores`` (default: the rewards),
    ``extra_logs`` (name -> per-row values) and ``teacher_log_probs`` (a list per row).

    A call that raises is made again for each datasource, then for each row; a row
    whose own call raises scores 0.0 with the message in ``error`` (null otherwise),
    so one bad row touches no other and the result does not depend on batches."""
    optional = {"datasources": ds_col, "query_token_ids": query_token_ids_col, "prompt_token_lens": prompt_token_lens_col}
    optional = {k: c for k, c in optional.items() if c}
    base = df.select(*dict.fromkeys([*keep, query_col, prompt_col, label_col, *optional.values()]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", " + _REWARD_FIELDS

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        res = reward_func(queries=pdf[query_col].tolist(), prompts=pdf[prompt_col].tolist(), labels=pdf[label_col].tolist(),
                          **{k: pdf[c].tolist() for k, c in optional.items()})
        rewards = [float(x) for x in res["rewards"]]
        scores = [float(x) for x in res.get("scores", rewards)]
        extra, teacher = res.get("extra_logs") or {}, res.get("teacher_log_probs") or [None] * n
        if not len(rewards) == len(scores) == len(teacher) == n:
            raise ValueError(f"{len(rewards)} rewards, {len(scores)} scores for {n} rows")
        return pdf.assign(reward=rewards, score=scores, extra=[{k: float(v[i]) for k, v in extra.items()} for i in range(n)],
                          teacher_log_probs=[None if t is None else [float(x) for x in t] for t in teacher], error=None)

    def contained(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return call(pdf)
        except Exception as e:  # the scorer is the caller's code
            if len(pdf) == 1:
                return pdf.assign(reward=0.0, score=0.0, extra=[{}], teacher_log_probs=[None], error=f"{type(e).__name__}: {e}")
        if ds_col and pdf[ds_col].nunique(dropna=False) > 1:
            parts = [contained(g) for _, g in pdf.groupby(ds_col, dropna=False, sort=False)]
        else:
            parts = [contained(pdf.iloc[i:i + 1]) for i in range(len(pdf))]
        return pd.concat(parts).sort_index()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield contained(pdf.reset_index(drop=True))

    return base.mapInPandas(run, schema)


def batch_call(df: DataFrame, client: Callable[[Any], Any], input_col: str, key_col: str,
               retries: int = 1, retry_on: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)
               ) -> DataFrame:
    """call ``client`` on every row of a batch in order; a timeout or
    connection error is retried ``retries`` times; each row gets
    ``success`` (1.0/0.0) and ``error`` (null on success). The client is
    created by the caller and shipped to the tasks."""
    schema = f"{key_col} {df.schema[key_col].dataType.simpleString()}, success double, error string"

    def run(batches):
        for pdf in batches:
            ok, err = [], []
            for x in pdf[input_col]:
                for attempt in range(retries + 1):
                    try:
                        r = client(x)
                        ok.append(1.0 if bool(r) else 0.0)
                        err.append(None)
                        break
                    except retry_on as e:
                        if attempt == retries:
                            ok.append(0.0)
                            err.append(f"{type(e).__name__}: {e}")
                    except Exception as e:  # not retried
                        ok.append(0.0)
                        err.append(f"{type(e).__name__}: {e}")
                        break
            yield pd.DataFrame({key_col: pdf[key_col], "success": ok, "error": err})

    return df.select(key_col, input_col).mapInPandas(run, schema)


def language_rewards(languages: list[str], make: Callable[[str], Callable[[], Column]]) -> dict[str, Callable[[], Column]]:
    """one registry entry per language from a factory."""
    return {lang: make(lang) for lang in languages}
