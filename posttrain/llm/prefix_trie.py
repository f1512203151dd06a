"""Prefix trie of conversations by parallel tree contraction (operator 13).

A node is a distinct sequence of first turns; its name is a 128-bit digest chained
over the turns while each conversation streams by in order.

1. Node rows are summed over the conversations that start with them.
2. Contraction, until the root is alone. *Compress*: each unary chain is jumped over
   by doubling, log2(length) join rounds, and the node below it hangs on the node above
   it; the chain's sum stays on that edge. *Rake*: all leaves are done; their totals are
   added up by parent. After a compress each inner node has two children at least, so
   each round halves the tree, whatever its shape.
3. Re-expansion, last round first: a node of a chain has the chain's sum from it
   down, plus the total of the node below the chain.

Every step is a sum by parent or a join on a unique name; the children of one node
are summed up before the shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm.common import ship_package, stored

CONV, TURN = "conv_id", "turn"
#: The root's name; others are digests.
ROOT = "CAST('' AS BINARY) AS node"
#: Width (in bits) of the id ranges whose ids are put together before they are hashed.
RANGE_BITS = 12


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, bytes, last``: one row per turn; ``last`` marks the
    whole conversation."""
    ship_package(turns.sparkSession)
    rows = turns.repartition(_parts(turns), CONV).sortWithinPartitions(CONV, TURN, "role", "text").select(CONV, "role", "text")
    kinds = [(CONV, pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

        held = None  # the row before, until it is known whether it is the last
        for batch in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    done.append((*held, not same))
                depth, parent = (held[1] + 1, held[2]) if same else (1, b"")
                body = text.encode()
                name = hashlib.blake2b(parent + len(role).to_bytes(8, "big") + role.encode() + body, digest_size=16).digest()
                held = (conv, depth, name, parent, len(body))
            yield told(done)
        if held is not None:
            yield told([(*held, True)])

    return rows.mapInArrow(run, f"{CONV} long, depth long, node binary, parent binary, bytes long, last boolean")


def _digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the ids of ``node, conv_id`` rows, ascending. Ids of one
    range are joined first, so a node where very many conversations end is a stream
    of ranges."""
    ranges = (ends.groupBy("node", F.shiftright(CONV, RANGE_BITS).alias("range"))
              .agg(F.array_join(F.sort_array(F.collect_list(CONV)).cast("array<string>"), ",").alias("ids")))
    rows = ranges.repartition(_parts(ends), "node").sortWithinPartitions("node", "range").select("node", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.string())], names=["node", "ends_sha256"])

        now, total = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if total is not None:
                        done.append((now, total.hexdigest()))
                    now, total = node, hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield told(done)
        if total is not None:
            yield told([(now, total.hexdigest())])

    return rows.mapInArrow(run, "node binary, ends_sha256 string")


def _chains(tree: DataFrame) -> DataFrame | None:
    """``node, end, w, l``: the unary nodes (but the root), the first node below each
    one's chain, and the sums from the node down to it. None if there are none."""
    unary = tree.where((F.col("kids") == 1) & F.col("parent").isNotNull())
    below = tree.select(F.col("parent").alias("node"), F.col("node").alias("end"), F.col("edge_w"), F.col("edge_l"),
                        ((F.col("kids") == 1) & F.col("parent").isNotNull()).alias("open"))
    chains = stored(unary.select("node", "w", "l").join(below, "node")
                    .select("node", "end", (F.col("w") + F.col("edge_w")).alias("w"), (F.col("l") + F.col("edge_l")).alias("l"), "open"), "chains")
    if chains.isEmpty():
        return None
    while not chains.where("open").isEmpty():
        jump = chains.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("w").alias("jw"), F.col("l").alias("jl"), F.col("open").alias("more"))
        moved = (chains.where("open").join(jump, "end")
                 .select("node", F.col("next").alias("end"), (F.col("w") + F.col("jw")).alias("w"), (F.col("l") + F.col("jl")).alias("l"), F.col("more").alias("open")))
        chains = stored(chains.where("NOT open").unionByName(moved), "chains")
    return chains.drop("open")


def _without_chains(tree: DataFrame, chains: DataFrame) -> DataFrame:
    """The tree with each chain as an edge."""
    inner = chains.select(F.col("node").alias("parent"), F.lit(True).alias("hangs"))
    tops = (tree.join(chains.select("node", "end", F.col("w").alias("sum_w"), F.col("l").alias("sum_l")), "node")
            .join(inner, "parent", "left").where("hangs IS NULL")
            .select(F.col("end").alias("node"), F.col("parent").alias("up"), (F.col("edge_w") + F.col("sum_w")).alias("up_w"), (F.col("edge_l") + F.col("sum_l")).alias("up_l")))
    rest = tree.join(chains.select("node"), "node", "left_anti").join(tops, "node", "left")
    return rest.select("node", F.coalesce("up", "parent").alias("parent"), "w", "l", "kids",
                       F.coalesce("up_w", "edge_w").alias("edge_w"), F.coalesce("up_l", "edge_l").alias("edge_l"))


def _raked(tree: DataFrame) -> DataFrame:
    """The tree without its leaves; their totals are in their parents."""
    leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
    sums = (tree.where(leaf).groupBy(F.col("parent").alias("node"))
            .agg(F.sum(F.col("w") + F.col("edge_w")).alias("more_w"), F.sum(F.col("l") + F.col("edge_l")).alias("more_l"), F.count("*").alias("n")))
    none = F.lit(0).cast("long")
    return tree.where(~leaf).join(sums, "node", "left").select(
        "node", "parent", (F.col("w") + F.coalesce("more_w", none)).alias("w"), (F.col("l") + F.coalesce("more_l", none)).alias("l"),
        (F.col("kids") - F.coalesce("n", none)).alias("kids"), "edge_w", "edge_l")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``node, w, l`` for a tree ``node, parent, weight`` (the root's parent is null): the
    sum of the weights in each node's subtree, and its number of leaves."""
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("long")
    tree = stored(nodes.join(kids, "node", "left").select(
        "node", "parent", F.col("weight").cast("long").alias("w"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("l"),
        F.coalesce("kids", zero).alias("kids"), zero.alias("edge_w"), zero.alias("edge_l")), "tree")
    done, chains = [], []
    while not tree.where("parent IS NOT NULL").isEmpty():
        chain = _chains(tree)
        if chain is not None:
            chains.append(chain)
            tree = stored(_without_chains(tree, chain), "compressed")
        done.append(tree.where("kids = 0 AND parent IS NOT NULL").select("node", "w", "l"))
        tree = stored(_raked(tree), "raked")
    totals = tree.select("node", "w", "l")
    for part in done:
        totals = totals.unionByName(part)
    for chain in reversed(chains):
        end = totals.select(F.col("node").alias("end"), F.col("w").alias("end_w"), F.col("l").alias("end_l"))
        totals = stored(totals.unionByName(chain.join(end, "end").select(
            "node", (F.col("w") + F.col("end_w")).alias("w"), (F.col("l") + F.col("end_l")).alias("l"))), "totals")
    return totals


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of each distinct sequence of first turns of ``turns`` (``conv_id, turn,
    role, text``), from the textless root on.

    Turns are taken by ``turn`` (nulls first), equal ones by role, then text, and repeated
    rows are turns of their own. Null roles and texts are empty. ``members`` (``conv_id``)
    names conversations that may have no turn; they end at the root. Rows without
    conv_id belong to no conversation and are left out. Without conversations there are no
    nodes. Other columns are ignored, whatever their names."""
    rows = turns.where(f"{CONV} IS NOT NULL").select(
        F.col(CONV).cast("long").alias(CONV), TURN, F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    steps = stored(prefixes(rows), "prefixes")
    convs = steps.where("depth = 1").select(CONV)
    if members is not None:
        convs = convs.unionByName(members.where(f"{CONV} IS NOT NULL").select(F.col(CONV).cast("long").alias(CONV))).distinct()
    convs = stored(convs, "members")
    root = (convs.agg(F.count("*").alias("n_convs"), F.min(CONV).alias(CONV)).where("n_convs > 0")
            .select(F.expr(ROOT), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), CONV, "n_convs", F.lit(0).cast("long").alias("bytes")))
    inner = steps.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min(CONV).alias(CONV),
                                      F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = stored(root.unionByName(inner.select(root.columns)), "nodes")
    totals = subtree_totals(nodes.select("node", "parent", ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight")))
    turnless = convs.join(steps.where("depth = 1").select(CONV), CONV, "left_anti").select(F.expr(ROOT), CONV)
    ends = _digests(steps.where("last").select("node", CONV).unionByName(turnless))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col(CONV).alias("parent_conv_id"))
    out = (nodes.join(above, "parent", "left").join(children, "node", "left").join(totals, "node").join(ends, "node", "left"))
    return out.select("node", CONV, "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                      F.col("l").alias("n_leaves"), F.col("w").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
