"""Near-duplicate groups by SuperMinHash (operator 1).

1. A scan turns each whole text into its set of word shingles, a key of the set
   and a SuperMinHash signature: every element draws its ranks from one random
   permutation, so ranks are correlated and estimates vary less than with
   independent hashes; an element stops as soon as its next rank cannot lower the
   largest slot.
2. Equal sets are one node, whatever their number of copies.
3. Slots are banded; a bucket links each member with its pivot, never all members
   with each other. Pairs whose sizes or signatures rule a link out are
   dropped; the nearest pair of each node is verified on full sets, and verified
   links are merged by union-find.
4. Nodes that are still apart are taken again: first with their other pivots, then,
   in buckets that hold several components, with the members that their signatures
   make likely; what is left meets each other and, block by block, the whole largest
   components of its buckets, so the choice of pivots loses no link.

Recall: two sets with similarity s meet in a band with probability
``1 - (1 - s^ROWS)^BANDS`` (s = 0.8: 0.999997), and the signature test drops a
pair at the threshold with probability below 1e-4."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, in_bitmap, key_bitmap, narrow, stored
from posttrain.llm.components import components
from posttrain.llm.set_check import verified

BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Bits of a slot in the signatures that pairs are compared by (slots fill 256 bits).
PLANES = 4
#: Standard errors beyond the threshold at which a signature rules a pair out.
MARGIN = 4.0
#: Sets of a component that are held together when a node is compared with all of it.
BLOCK = 256
#: Elements whose permutations are held at once (2 bytes a slot each).
ELEMENTS = 40_000
_SEED = np.uint64(0xD1B54A32D192ED03)


def super_min_hash(values: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """``sets x slots`` signatures (step in the high bits, random fraction in the
    low ones) of the sets ``values[first[i]:first[i + 1]]``; all ones for an empty
    set."""
    n_sets = len(first) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_sets * slots, top, np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(first))
    state, perm = values, None
    for j in range(slots):
        if len(owner) == 0:
            break
        state = K.mix64(state + _SEED)
        rank = (np.uint64(j) << np.uint64(48)) | (state >> np.uint64(16))
        pick = j + ((state & np.uint64(0xFFFF)) * np.uint64(slots - j) >> np.uint64(16)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            rows = np.arange(len(owner))
            slot = perm[rows, pick]
            perm[rows, pick] = perm[:, j]
            slot = slot.astype(np.int64)
        np.minimum.at(out, owner * slots + slot, rank)
        # early stop: the next rank is above every slot of the set
        worst = out.reshape(n_sets, slots).max(axis=1) >> np.uint64(48)
        going = (worst > np.uint64(j))[owner]
        if not going.all() or perm is None:
            before = perm
            owner, state = owner[going], state[going]
            if before is None:
                perm = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(owner), slots)).copy()
                rows = np.arange(len(owner))
                perm[rows, pick[going]] = j  # slot j went to the picked place
            else:
                perm = before[going]
    return out.reshape(n_sets, slots)


def signatures(docs: DataFrame, width: int, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, version, n, key binary, bits array<long>, bands array<long>`` per input
    row; ``bits`` has ``PLANES`` bits of each slot, a plane after the other; ``version`` is a hash of the text. Rows
    without words have n = 0 and a null key."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, values, first in K.shingle_sets(batch.column(1), width):
            n = np.diff(first)
            sig = np.empty((len(n), SLOTS), np.uint64)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + ELEMENTS, "right")) - 1)
                sig[lo:hi] = super_min_hash(values[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
                lo = hi
            band = np.full((len(n), BANDS), 0, np.uint64)
            for r in range(ROWS):
                band = K.mix64(band * K.MIX_GOLDEN + sig[:, r::ROWS])
            band ^= np.arange(BANDS, dtype=np.uint64)[None, :] * K.MIX_B
            mixed = K.mix64(sig)
            planes = np.zeros((len(n), PLANES, 256), np.uint8)
            for p in range(PLANES):
                planes[:, p, :SLOTS] = mixed >> np.uint64(p) & np.uint64(1)
            bits = np.packbits(planes.reshape(len(n), -1), axis=1).view(np.int64)
            keys = pc.if_else(pa.array(n > 0), K.key_array(K.set_keys(values, first)), pa.scalar(None, pa.binary()))
            rows = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(n)), batch.column(2).slice(at, len(n)), pa.array(n), keys,
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 4 * PLANES), pa.array(bits.ravel())),
                 pa.ListArray.from_arrays(rows, pa.array(band.view(np.int64).ravel()))],
                names=[ID, "version", "n", "key", "bits", "bands"])

    rows = narrow(docs, id_col, text_col).withColumn("version", F.xxhash64(TEXT))
    return arrow_map(rows, run, f"{ID} long, version long, n long, key binary, bits array<long>, bands array<long>")


def _apart(x: str, y: str) -> str:
    """Number of slots whose ``PLANES`` bits differ between two node columns."""
    differ = [" | ".join(f"({x}.bits[{4 * p + i}] ^ {y}.bits[{4 * p + i}])" for p in range(PLANES)) for i in range(4)]
    return "(" + " + ".join(f"bit_count({d})" for d in differ) + ")"


def _expected_apart(percent: int, margin: float = 0.0) -> int:
    """Differing slots of two sets at the threshold, plus ``margin`` standard errors."""
    p = (1 - percent / 100) * (1 - 2.0 ** -PLANES)
    return int(SLOTS * p + margin * np.sqrt(SLOTS * p * (1 - p)))


def _may_link(x: str, y: str, percent: int, most: int | None = None) -> str:
    """Size and signature bounds of a pair: at most ``most`` slots differ (as a rule:
    what ``MARGIN`` allows)."""
    most = _expected_apart(percent, MARGIN) if most is None else most
    return f"least({x}.n, {y}.n) * 100 >= greatest({x}.n, {y}.n) * {percent} AND {_apart(x, y)} <= {most}"


def _sets(docs: DataFrame, keys: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``key, items array<long>`` of the wanted keys (``key, doc_id``: one document
    that has the set). A bitmap of fixed size keeps other documents' texts from being
    cut up and moved; the join is exact."""
    bitmap = key_bitmap(keys, F.xxhash64(ID))
    rows = narrow(docs, id_col, text_col).withColumn("h", F.xxhash64(ID))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = pa.array(in_bitmap(bitmap, batch.column(2).to_numpy())) if len(batch) else pa.array([], pa.bool_())
        for _, values, first in K.shingle_sets(batch.column(1).filter(hit), width):
            yield pa.RecordBatch.from_arrays(
                [K.key_array(K.set_keys(values, first)), K.list_array(values.view(np.int64), first, pa.int64())], names=["key", "items"])

    found = arrow_map(rows, run, "key binary, items array<long>")
    # a key names one set, whichever document it comes from; ids may be null
    return found.join(keys.select("key"), "key").dropDuplicates(["key"]).select("key", "items")


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``a, b, apart`` of node columns ``x`` and ``y``, the smaller key first."""
    return rows.select(F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b"),
                       F.expr(_apart(x, y)).alias("apart"))


def _nearest(pairs: DataFrame, ends: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The pair with the fewest differing slots of each node."""
    return (pairs.select("a", "b", "apart", F.explode(F.array(*ends)).alias("node")).groupBy("node")
            .agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b").distinct())


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for side in ("a", "b"):
        pairs = (pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
                 .withColumn(f"r{side}", F.coalesce(f"r{side}", side)))
    return pairs.where("ra <> rb").drop("ra", "rb")


def _roots(docs: DataFrame, nodes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``node, root`` for the nodes that are linked with another one."""
    def check(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("a", "b"), "pairs")
        return stored(verified(pairs, _needed(docs, pairs, nodes, width, id_col, text_col), percent), "links")

    spread = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    shared = stored(spread.join(shared, "bucket"), "buckets")  # most buckets have one member
    members = stored(shared.join(nodes.select("key", F.struct("key", "n", "bits").alias("x")), "key").select("bucket", "band", "x"), "members")

    # one pivot a bucket, by an order that all buckets share: a large group has few of them
    order = F.struct(F.xxhash64("x.key").alias("h"), "x")
    pivots = members.groupBy("bucket").agg(F.min(order)["x"].alias("y"))
    meet = members.join(pivots, "bucket").where("x.key <> y.key").where(F.expr(_may_link("x", "y", percent)))
    near = stored(_pairs(meet, "x", "y").distinct(), "near")
    best = stored(_nearest(near), "best")
    links = check(best)
    roots = components(links)

    # other pivots, for nodes that are still in another component
    more = check(_between(near.join(best, ["a", "b"], "left_anti"), roots))
    links = links.union(more)
    roots = components(links)

    def open_buckets() -> DataFrame:
        """Members, with their component and their bucket's largest one, of the
        buckets that hold several components."""
        known = members.withColumn("key", F.col("x.key")).join(roots.withColumnRenamed("node", "key"), "key", "left")
        known = known.withColumn("root", F.coalesce("root", "key"))
        parts = known.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        main = parts.groupBy("bucket").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
        return stored(known.join(main, "bucket"), "open")

    def meet_open(rows: DataFrame, most: int, outside: str) -> DataFrame:
        """Pairs of a member outside its bucket's largest component with members of
        other components, once, in the first band that they share."""
        small = rows.where("root <> main").select("bucket", F.col("x").alias("y"), F.col("root").alias("ry"), F.col("bands").alias("by"))
        met = (rows.join(small, "bucket").where(f"root <> ry AND ({outside})").where(F.expr(_may_link("x", "y", percent, most)))
               .where(f"NOT exists(sequence(0, {BANDS - 1}), i -> i < band AND bands[i] = by[i])"))
        return stored(_pairs(met, "x", "y").join(near, ["a", "b"], "left_anti"), "met")

    # likely links across components
    banded = open_buckets().join(nodes.select("key", "bands"), "key")
    likely = meet_open(banded, _expected_apart(percent), "root = main OR x.key < y.key")
    links = links.union(check(likely))
    roots = components(links)

    # what is left: members outside the largest components with each other, then with the
    # largest ones as a whole, block by block
    left = open_buckets()
    banded = left.join(nodes.select("key", "bands"), "key")
    links = links.union(check(meet_open(banded, _expected_apart(percent, MARGIN), "root <> main AND x.key < y.key")))
    asked = stored(left.where("root <> main").select(F.col("key").alias("f"), F.col("main").alias("root")).distinct(), "asked")
    whole = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = whole.join(asked.select("root").distinct(), "root", "left_semi").select("root", "key", "n", "bits")
    blocks = whole.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = whole.select("key").union(asked.select(F.col("f").alias("key"))).distinct()
    sets = stored(_sets(docs, nodes.select("key", ID).join(wanted, "key", "left_semi"), width, id_col, text_col), "sets")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    there = (whole.join(blocks, "root").join(sets, "key").select("root", block, F.struct("key", "n", "bits", "items").alias("y"))
             .groupBy("root", "block").agg(F.collect_list("y").alias("ys")))  # about BLOCK sets
    here = (asked.join(blocks, "root").join(nodes.select(F.col("key").alias("f"), "n", "bits"), "f")
            .join(sets.select(F.col("key").alias("f"), "items"), "f")
            .select("root", F.struct(F.col("f").alias("key"), "n", "bits", "items").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    common = "size(array_intersect(x.items, y.items))"
    hit = F.expr(f"filter(ys, y -> if({_may_link('x', 'y', percent)}, {100 + percent} * {common} >= {percent} * (x.n + y.n), false))")
    last = stored(here.join(there, ["root", "block"]).select("x.key", F.explode(hit).alias("y"))
                  .select(F.col("key").alias("a"), F.col("y.key").alias("b")), "links")
    return components(links.union(last))


def _needed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return stored(_sets(docs, nodes.select("key", ID).join(keys, "key", "left_semi"), width, id_col, text_col), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, version`` per input row.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a text's set
    is its distinct ``width``-word shingles (a shorter text: its whole sequence).
    Texts with 100 * intersection >= ``percent`` * union are linked; components are
    named by their smallest doc_id. A null or empty text, or one without words, has
    0 shingles and is alone. Rows repeated with the same id and text share a
    component (all of them are marked kept if their id names it); of several texts
    under that id the one with the smallest ``version`` is kept. A null id never
    names a component unless no member has one. An empty table gives no rows; other
    columns are ignored."""
    sigs = stored(signatures(docs, width, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col(ID).isNull().alias("none"), ID, "version"))  # null ids come last
    nodes = stored(sigs.where("key IS NOT NULL").groupBy("key").agg(
        first[ID].alias(ID), first["version"].alias("version"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes")
    roots = _roots(docs, nodes, width, percent, id_col, text_col)
    named = nodes.select("key", ID, "version").join(roots, F.col("key") == F.col("node"), "left").select("key", ID, "version", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(first[ID].alias("component_id"), first["version"].alias("kept_version"))
    by_key = named.join(smallest, "root").select("key", "component_id", "kept_version")
    name = F.coalesce("component_id", ID)
    return (sigs.select(ID, "n", "key", "version").join(by_key, "key", "left")
            .select(ID, F.col("n").alias("n_shingles"), name.alias("component_id"),
                    (F.col(ID).eqNullSafe(name) & F.coalesce(F.col("version") == F.col("kept_version"), F.lit(True))).alias("kept"), "version"))
