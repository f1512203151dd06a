"""The llm queries: one ``opN_<name>`` per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttrain.llm import bpe, conversation_repair, decontaminate, exact_dedup, language_id, line_dedup, minhash, prefix_trie, quality, secret_scan, substring_dedup, toxicity, url_lists
from posttrain.llm.common import ID, TEXT, documents, split_no, stored
from posttrain.session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's decisions, with the digest of every text, which goes through
    the operator's own scan, beside them."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), with_sha=True).withColumnRenamed("digest", "text_sha256")


ORACLE["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(documents(spark, sf_dir))))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = _labels(spark, sf_dir).where(split_no(ID, 3) != 1)
    scored, _ = toxicity.fit_and_score(documents(spark, sf_dir), learn)
    return scored.select(ID, (split_no(ID, 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    model = language_id.fit(docs.where((split_no(ID, 4) != 2) & F.col("lang").isNotNull()))
    found = language_id.predict(docs, model)
    return found.select(ID, (split_no(ID, 4) == 2).alias("held_out"), "lang_pred", "score")


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = _labels(spark, sf_dir).where(split_no(ID, 5) != 0)
    scored = quality.classify(documents(spark, sf_dir), learn)
    return scored.select(ID, (split_no(ID, 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    spans = F.expr("transform(kinds, (k, i) -> concat_ws(':', k, starts[i], ends[i]))")
    found = found.withColumn("all", spans).withColumn("base", F.expr("filter(all, s -> NOT startswith(s, 'novel'))"))
    counts = [F.expr(f"cast(size(filter(kinds, k -> k = '{k}')) as long)").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(ID, *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))


# Captures and a dated list, derived from the pages: the fetch day follows from the
# page's number; hosts, their parent domains and path prefixes are listed, dropped and
# listed again on days that follow from a hash of their name.
_DAY0 = "DATE '2024-01-01'"
_H = "(strpos('0123456789abcdef', substr(md5(value), {0}, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(value), {1}, 1)) - 1"
_H1, _H2, _H3 = _H.format(1, 2), _H.format(3, 4), _H.format(5, 6)


def _list_entries(values: DataFrame) -> DataFrame:
    """Dated entries for ``kind, value`` rows: about a third of them are listed."""
    h = [F.expr(x.replace("strpos(", "instr(")) for x in (_H1, _H2, _H3)]
    first = h[1]
    days = F.array(F.struct(first.alias("d"), F.lit("add").alias("action")),
                   F.struct((first + 30 + h[2] % 60).alias("d"), F.lit("remove").alias("action")),
                   F.struct((first + 120 + h[2] % 40).alias("d"), F.lit("add").alias("action")))
    return (values.where(h[0] < 88).select("kind", "value", F.explode(days).alias("e"))
            .select("kind", "value", F.date_add(F.expr(_DAY0), F.col("e.d").cast("int")).alias("day"), "e.action"))


@_query
def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.expr(_DAY0), (F.col("page_id") * 37 % 366).cast("int")))
    host = url_lists.host(F.col("url"))
    values = (pages.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("value")),
        F.struct(F.lit("prefix").alias("kind"), url_lists.path_prefix(F.col("url")).alias("value")))).alias("e"))
        .select("e.kind", "e.value").distinct().where("value <> ''"))
    return url_lists.match(captures, _list_entries(values))


ORACLE["op7_url_lists"] = rf"""
WITH cap AS (
  SELECT page_id, rtrim_dot AS host, rtrim_dot || '/' || regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/([^/?#]*)', 1) AS prefix,
    CAST({_DAY0} + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS day
  FROM (SELECT page_id, lower(coalesce(url, '')) AS u,
      regexp_replace(regexp_extract(lower(coalesce(url, '')), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]$', '') AS rtrim_dot
    FROM pages)),
val AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'host' AS kind, host AS value FROM cap
    UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) FROM cap
    UNION ALL SELECT 'prefix', prefix FROM cap) WHERE value <> ''),
hashed AS (SELECT kind, value, {_H1} AS h1, {_H2} AS h2, {_H3} AS h3 FROM val),
spans AS (
  SELECT kind, value, CAST({_DAY0} + CAST(h2 AS INTEGER) AS DATE) AS since, CAST({_DAY0} + CAST(h2 + 30 + h3 % 60 AS INTEGER) AS DATE) AS until
  FROM hashed WHERE h1 < 88
  UNION ALL SELECT kind, value, CAST({_DAY0} + CAST(h2 + 120 + h3 % 40 AS INTEGER) AS DATE), DATE '9999-12-31' FROM hashed WHERE h1 < 88),
hit AS (
  SELECT DISTINCT c.page_id, s.kind, s.value FROM cap c JOIN spans s
    ON ((s.kind = 'host' AND s.value = c.host) OR (s.kind = 'prefix' AND s.value = c.prefix)
      OR (s.kind = 'domain' AND (c.host = s.value OR ends_with(c.host, '.' || s.value))))
    AND s.since <= c.day AND c.day < s.until WHERE c.host <> ''),
got AS (SELECT page_id, count(*) AS n, string_agg(kind || ':' || value, ',' ORDER BY kind || ':' || value) AS m FROM hit GROUP BY page_id)
SELECT c.page_id, c.host, c.day, coalesce(g.n, 0) AS n_matches, coalesce(g.m, '') AS matches, g.n IS NOT NULL AS blocked
FROM cap c LEFT JOIN got g ON c.page_id = g.page_id
"""


@_query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)
    # by id alone: the operator's own choice among texts of one id is in kept_version
    return found.withColumnRenamed("kept", "kept_version").withColumn("kept", F.col(ID).eqNullSafe(F.col("component_id")))


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select(ID, F.size("dropped_lines").cast("long").alias("n_dropped"),
                      F.concat_ws(",", F.col("dropped_lines").cast("array<string>")).alias("dropped"),
                      "seen_in", F.sha2(F.coalesce(TEXT, F.lit("")), 256).alias("kept_sha256"))


@_query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(ID, "item_id", "distance", "start", "end")


@_query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return out.select(ID, "n_words", "n_removed", F.sha2(TEXT, 256).alias("kept_sha256"))


ORACLE["op11_substring_dedup"] = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM doc),
win AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM doc)),
late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS first_id FROM win) WHERE first_id < doc_id),
cover AS (
  SELECT word.doc_id, word.pos, w, max(CASE WHEN late.pos IS NOT NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY word.doc_id ORDER BY word.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN late ON word.doc_id = late.doc_id AND word.pos = late.pos),
got AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
  coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM cover GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN got ON d.doc_id = got.doc_id
"""


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn``, repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    damaged = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                          "kind", F.explode(copies).alias("copy"))
    faulty = conversation_repair.faulty_rows(damaged, F.col("kind") == 0)
    found = stored(conversation_repair.audits(faulty), "audits")
    digest = conversation_repair.repaired_digests(faulty, found)
    both = found.alias("a").join(digest.alias("b"), F.expr("a.conv_id <=> b.conv_id"))
    return both.select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that are rebuilt on the first turns of another one."""
    ship_package(spark)
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = stored(rows.withColumn("place", place.cast("long")), "placed_turns")
    convs = stored(rows.select("conv_id").distinct().select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"),
                                                            (F.col("conv_id") - F.col("conv_id") % 5).alias("source")), "conversation_ids")
    # the turns that others begin with are eight at most, and so are their takers
    given = (rows.where("place <= 8").withColumnRenamed("conv_id", "source").join(convs, "source").where("place <= h")
             .select("conv_id", F.col("place").alias("turn"), "role", "text"))
    # own turns come after them; their places need not be without gaps
    own = rows.join(convs, "conv_id").where("place > h").select("conv_id", F.col("place").alias("turn"), "role", "text")
    return prefix_trie.prefix_trie(given.unionByName(own), convs).drop("node")


ORACLE["op13_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, xor(list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)),
    4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.source AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
step AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    array_to_string(list(md5(length(role) || ':' || role || text)) OVER w, ',') AS path
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
member AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS path, NULL AS up FROM conv
  UNION ALL SELECT conv_id, depth, bytes, md5(path), CASE WHEN depth = 1 THEN '' ELSE md5(left(path, length(path) - 33)) END FROM step),
node AS (SELECT path, any_value(depth) AS depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM member GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
total AS (
  SELECT above.path, sum((n.n_convs - 1) * n.bytes) AS saved, sum(CASE WHEN kids.path IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM node n JOIN member above ON above.conv_id = n.conv_id AND above.depth <= n.depth LEFT JOIN kids ON kids.path = n.path GROUP BY above.path),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM member GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node n JOIN total ON total.path = n.path LEFT JOIN node p ON p.path = n.up LEFT JOIN kids ON kids.path = n.path LEFT JOIN ends ON ends.path = n.path
"""
