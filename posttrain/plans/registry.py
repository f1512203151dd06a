"""Query registry: each query key maps to a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where the result is expressible in SQL, the DuckDB oracle
text over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from posttrain.plans.fixtures import with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6  # D~ checks round doubles to this many decimals in both engines


def _round_digits(sql: str, digits: int = DIGITS) -> str:
    """Rewrite every ``round(expr, digits)`` of an oracle query into
    ``(round(round(expr, 9), digits) + 0.0)``: the same two-step rounding
    :func:`rnd` does on the Spark side, so float noise from a different
    operation order cannot flip a value that sits on a rounding boundary, and
    -0.0 becomes 0.0."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        # find the matching parenthesis and the last top-level comma
        depth, k, comma, quote = 0, j + 5, -1, None
        while k < len(sql):
            ch = sql[k]
            if quote:
                if ch == quote:
                    quote = None
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0 or sql[comma + 1:k].strip() != str(digits):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        inner = _round_digits(sql[j + 6:comma], digits)
        out.append(sql[i:j])
        out.append(f"(round(round({inner}, 9), {digits}) + 0.0e0)")
        i = k + 1


def query(name: str, sql: str | None = None, fixtures: tuple[str, ...] = (), recursive: bool = False):
    """Register a query; ``recursive``: its oracle has recursive CTEs."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            text = _round_digits(sql)
            if fixtures:
                ORACLE[name] = with_fixtures(text, *fixtures)
            elif text.lstrip().startswith(","):
                # CTE continuation without fixture views
                ORACLE[name] = "WITH " + text.lstrip()[1:]
            else:
                ORACLE[name] = text
            if recursive:
                ORACLE[name] = ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return fn
    return deco


def _half_away(x: Column, digits: int) -> Column:
    """Round half away from zero on the binary value: sign(x) *
    floor(|x| * 10^d + 0.5) / 10^d - the rule DuckDB's round applies, so
    both engines give the same double for the same input."""
    p = F.lit(float(10 ** digits))
    r = F.signum(x) * F.floor(F.abs(x) * p + F.lit(0.5)).cast("double") / p
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(1e9)), x).otherwise(r)


def rnd(c, digits: int = DIGITS) -> Column:
    """Round a double for the D~ comparison: first to 9 digits (absorbs float
    noise from a different operation order), then to ``digits``; -0.0 -> 0.0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return _half_away(_half_away(x, 9), digits) + F.lit(0.0)
