"""Exact dedup by progressive refinement (operator 5), DataFrame functions only.

1. One scan keeps three narrow numbers per row: id, length in bytes and the hash
   of the first ``prefix_chars`` characters.
2. Rows whose length, then whose (length, prefix hash), occurs once are unique.
3. The surviving (length, prefix hash) groups are marked in a bitmap of fixed
   size; a second scan computes the full hash for rows that hit it and for no
   others, so full content is read for survivors only and no text is shuffled.
4. Full hashes are grouped; the largest id of each group stays.

All grouping is by hash aggregation with partial sums before the shuffle; a group
of a third of all rows costs one row per task. The last join, which carries two hashes
per row, meets no hot key: groups that hold ``1 / HOT_GROUPS`` of all repeated rows or
more, of which there are ``HOT_GROUPS`` at most, are broadcast, and rows that need no
group are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm.common import ID, TEXT, narrow, stored

#: Bits of the survivors' bitmap: 2^23 bits are 1 MB, whatever the input.
FILTER_BITS = 23
HOT_GROUPS = 256
_ROW_BITS = 15  # bits of one bitmap row: what bitmap_construct_agg makes


def exact_dedup(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, prefix_chars: int = 128, with_sha: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` per input row; ``digest`` (sha256)
    is there for the rows that step 3 reads, ``with_sha`` takes it of every row.

    Texts are equal when identical; null counts as empty, so all null and empty
    texts are one group. Of equal texts the row with the largest id is kept; a
    null id counts as smallest, and rows repeated with the same id share one
    decision (all of them are kept or dropped). An empty table gives no rows;
    other columns are ignored, whatever their names."""
    text = F.coalesce(F.col(TEXT), F.lit(""))
    rows = narrow(docs, id_col, text_col).select(
        ID, text.alias(TEXT), F.octet_length(text).alias("len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("head"))

    groups = rows.groupBy("len", "head").agg(F.count("*").alias("n"))
    by_length = groups.groupBy("len").agg(F.sum("n").alias("n_len"), F.max("n").alias("n_head"))
    # lengths seen once are done; then (length, prefix) groups seen once are
    alive = groups.join(by_length.where("n_len > 1 AND n_head > 1"), "len", "left_semi").where("n > 1")

    bit = F.pmod(F.xxhash64("len", "head"), F.lit(1 << FILTER_BITS))
    bitmap = stored(alive.select(bit.alias("bit")).groupBy(F.shiftright("bit", _ROW_BITS).alias("slot"))
                    .agg(F.bitmap_construct_agg(F.col("bit") % (1 << _ROW_BITS)).alias("bits")), "survivors")
    # at most 2^(FILTER_BITS - _ROW_BITS) rows of 4 KB: a proven bound
    here = F.col("bit") % (1 << _ROW_BITS)
    byte = F.conv(F.hex(F.substring("bits", (here / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = (rows.withColumn("bit", bit).withColumn("slot", F.shiftright("bit", _ROW_BITS))
              .join(F.broadcast(bitmap), "slot", "left")
              .withColumn("byte", F.coalesce(byte, F.lit(0)))
              .withColumn("alive", F.expr("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1")))
    sha = F.sha2(TEXT, 256)
    full = stored(marked.select(ID, "len", "head", sha.alias("digest") if with_sha else F.when(F.col("alive"), sha).alias("digest"), "alive"), "digests")

    same = stored(full.where("alive").groupBy("len", "digest")
                  .agg(F.max(ID).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    repeated = same.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") * HOT_GROUPS >= repeated
    few = same.where(hot).select("len", "digest", F.struct("keep_id", "group_size").alias("hot"))
    rest = same.where(~hot).select(F.col("len").alias("key_len"), F.col("digest").alias("key"), F.struct("keep_id", "group_size").alias("rest"))
    asks = F.col("hot").isNull() & F.col("alive")
    found = (full.join(F.broadcast(few), ["len", "digest"], "left")
             .withColumn("key", F.when(asks, F.col("digest")).otherwise(F.col(ID).cast("string")))
             .withColumn("key_len", F.when(asks, F.col("len")).otherwise(F.lit(-1)))
             .join(rest, ["key_len", "key"], "left"))
    group = F.coalesce("hot", "rest")
    keep = F.when(group.isNull(), F.col(ID)).otherwise(group["keep_id"])
    return found.select(
        ID, keep.alias("keep_id"), F.coalesce(group["group_size"], F.lit(1)).cast("long").alias("group_size"),
        F.col(ID).eqNullSafe(keep).alias("kept"), "digest")
