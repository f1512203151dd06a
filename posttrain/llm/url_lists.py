"""URL filters by temporal list join (operator 7), DataFrame functions only.

A list is a table of dated entries: ``kind`` ('domain' covers the host and its
subdomains, 'host' one host, 'prefix' a host with its first path segment),
``value``, ``day`` and ``action`` ('add' or 'remove'). Entries become validity
intervals; every capture is evaluated against the intervals that hold on its
fetch day.

A capture looks up its host, its host's suffixes and its path prefix by equality;
each key has one row on the list side (its intervals, as many as it has days), so
the join makes no more rows than captures have keys. A host may have a third of
all captures: the key carries a salt of ``SALT`` values, and the list side is
repeated for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = 16
_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/([^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; '' if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), _HOST, 1), r"\.$", "")


def path_prefix(url: Column) -> Column:
    """``host/first segment``, lower-case; ends with the slash if there is none."""
    return F.concat(host(url), F.lit("/"), F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), _PATH, 1))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``kind, value, spans array<struct<since, until>>``: half-open day intervals
    in which a key is listed; an open end is null. On a day with several entries of
    a key 'add' wins over 'remove'. A repeated add or a remove without an add
    changes nothing. Entries without kind, value, day or a known action are left
    out. One day counts once, so a key's list is as long as its days at most."""
    daily = (entries.where("kind IS NOT NULL AND value IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
             .groupBy("kind", F.lower("value").alias("value"), F.col("day").cast("date").alias("day"))
             .agg(F.max(F.col("action") == "add").alias("listed")))
    history = daily.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("day", "listed"))).alias("h"))
    until = F.expr("transform(h, (e, i) -> named_struct('listed', e.listed, 'since', e.day, 'until', get(h, i + 1).day))")
    return (history.withColumn("h", until).select("kind", "value", F.expr(
        "transform(filter(h, e -> e.listed), e -> named_struct('since', e.since, 'until', e.until))").alias("spans"))
        .where(F.size("spans") > 0))


def match(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
          day_col: str = "day") -> DataFrame:
    """``page_id, host, day, n_matches, matches, blocked`` per capture: the sorted
    ``kind:value`` entries active on its day. A capture without a host or a day
    matches nothing. Repeated rows give a row each; without entries every capture
    passes; an empty table gives no rows; other columns are ignored."""
    seen = captures.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"),
                           path_prefix(F.col(url_col)).alias("prefix"), F.col(day_col).cast("date").alias("day"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), "
                      "i -> struct('domain' as kind, array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.') as value))")
    keys = F.concat(suffixes, F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
                                      F.struct(F.lit("prefix").alias("kind"), F.col("prefix").alias("value"))))
    # each distinct (host, prefix, day) is looked up once, however many captures it has
    distinct = seen.where("host <> '' AND day IS NOT NULL").select("host", "prefix", "day").distinct()
    asked = (distinct.withColumn("key", F.explode(keys))
             .select("host", "prefix", "day", "key.kind", "key.value",
                     F.pmod(F.xxhash64("prefix", "day"), F.lit(SALT)).cast("int").alias("salt")))
    listed = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    active = (asked.join(listed, ["kind", "value", "salt"])
              .where(F.expr("exists(spans, s -> s.since <= day AND (s.until IS NULL OR day < s.until))")))
    found = active.groupBy("host", "prefix", "day").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "value"))), ",").alias("matches"),
        F.countDistinct("kind", "value").alias("n_matches"))
    out = seen.join(found, ["host", "prefix", "day"], "left")
    return out.select("page_id", "host", "day", F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
                      F.coalesce("matches", F.lit("")).alias("matches"),
                      F.col("n_matches").isNotNull().alias("blocked"))
