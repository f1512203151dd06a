"""Benchmark decontamination (operator 2): every place of a document within
``max_edit`` of an item, by exact pieces of the item and edit verification.

Texts are compared without case (A-Z) and with runs of white space as one space, by
code point. No step loses a match:

1. An item that may have ``k`` edits is cut into ``k // 2 + 1`` groups, a group into
   two leaves. More groups than half the edits: some group has one edit at most, and
   one of its leaves none. Every place of the text is looked up among the leaves,
   whatever the script; words and spaces play no part.
2. Beside a leaf the other one must follow with one edit at most.
3. Neighbouring groups form nodes of at most 64 characters, in two levels. A node of
   ``j`` groups has fewer than ``2 j`` edits for some path from item to leaf, so both
   nodes over the leaf must align with the text around (Myers' columns in 64-bit words,
   many places at once).
4. What is left is aligned as a whole with the text around.

Steps 1 to 3 see characters as classes of 8 or 6 bits, which only adds places. Items
so short, or ``max_edit`` so large, that a leaf would be empty are aligned with whole
texts.

Embedding and sampling (CGK, bit-sampling LSH) are not used: they would lose some of
the places that these steps find.

Benchmarks are a stated query set: they go to the tasks in blocks of at most about
``BLOCK_BYTES``, each of them against all rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, narrow, stored

BLOCK_BYTES = 8 << 20
#: Texts are worked on in slices of so many bytes, places and alignments so many at once.
SLICE_BYTES, PLACES, COLUMNS = 1 << 18, 1 << 15, 1 << 13
#: Groups in a node of each level, as far as they fit ``NODE`` characters.
LEVELS, NODE, PACKED = (3, 6), 64, 8


def normal(text: str) -> str:
    """A-Z lower-cased, ASCII white space as single spaces, none at the ends."""
    lowered = text.encode().translate(bytes(K.lower(np.arange(256, dtype=np.uint8))))
    return b" ".join(lowered.split()).decode()


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points ^ points >> 8 ^ points >> 16) & 0xFF).astype(np.uint8)


def _packed(classes: np.ndarray) -> np.ndarray:
    """For each place, and the end, the next ``PACKED`` classes as one word."""
    raw = np.concatenate([classes, np.zeros(PACKED, np.uint8)])
    return np.ndarray(len(classes) + 1, "<u8", raw, strides=(1,)).astype(np.uint64)


def _word(classes: np.ndarray) -> int:
    return int.from_bytes(classes.tobytes(), "little")


class Leaves(NamedTuple):
    """The leaves of one length: ``first`` has the range of each hash slot in the other
    arrays; ``offset`` is the leaf's place in its item, ``other`` the packed leaf beside
    it, to be read onwards (``back`` 0) or backwards from the leaf, ``nodes`` the node
    of each level."""

    length: int
    shift: np.uint64
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    back: np.ndarray
    other: np.ndarray
    mask: np.ndarray
    nodes: np.ndarray


class Plan:
    """How the items are looked for with ``max_edit``: leaves, and nodes with their
    place in the item, place in all items, length and edits."""

    def __init__(self, texts: list[str], max_edit: float):
        self.limit = np.array([min(int(len(t) * max_edit), len(t) - 1) for t in texts], np.int64)
        points = [_code_points(t) for t in texts]
        self.size = np.array([len(x) for x in points], np.int64)
        self.classes = _classes(np.concatenate([*points, np.zeros(0, np.uint32)]))
        base = np.cumsum(self.size) - self.size
        self.whole, nodes, found = [], [], defaultdict(list)
        for i, (m, k) in enumerate(zip(self.size.tolist(), self.limit.tolist(), strict=True)):
            groups = k // 2 + 1
            if k and m < 2 * groups:
                self.whole.append(i)
                continue
            cut = [m * g // groups for g in range(groups + 1)]
            one, of = self.classes[base[i]:base[i] + m], []
            for most in LEVELS:
                # the larger node holds whole smaller ones
                most = max(1, min(most, NODE // -(-m // groups) // LEVELS[0] * LEVELS[0] or NODE // -(-m // groups)))
                of.append([])
                for g in range(0, groups, most):
                    a, b = cut[g], cut[min(g + most, groups)]
                    if b - a > NODE:
                        a, b = (a + b) // 2 - NODE // 2, (a + b) // 2 + NODE // 2
                    of[-1] += [len(nodes)] * (min(g + most, groups) - g)
                    nodes.append((a, base[i] + a, b - a, min(2 * (min(g + most, groups) - g) - 1, k)))
            for g in range(groups):
                a, b = cut[g], cut[g + 1]
                mid = (a + b) // 2 if k else b
                left, right = one[max(a, mid - PACKED):mid], one[mid:min(b, mid + PACKED)]
                for leaf, at, other, back in ((left, mid - len(left), right, 0), (right, mid, left[::-1], 1)):
                    if len(leaf):
                        found[len(leaf)].append((_word(leaf), i, at, back, _word(other), (1 << 8 * len(other)) - 1, *(n[g] for n in of)))
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4).T
        self.leaves = []
        for length, rows in sorted(found.items()):
            cols = [np.array(c, np.uint64) for c in zip(*rows, strict=True)]
            bits = min(max(len(rows).bit_length() + 4, 12), 24)
            shift = np.uint64(64 - bits)
            slot = (cols[0] * K.MIX_GOLDEN >> shift).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            first = np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32)
            item, offset, back, *nodes_of = (cols[c][order].astype(np.int64) for c in (1, 2, 3, 6, 7))
            self.leaves.append(Leaves(length, shift, first, item, offset, back, cols[4][order], cols[5][order], np.stack(nodes_of)))


class Items:
    """A block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        found = [(i, normal(t)) for i, t in rows if t is not None]
        found = [(i, t) for i, t in found if t]
        self.ids, self.texts = [i for i, _ in found], [t for _, t in found]
        self.plans: dict[float, Plan] = {}

    def plan(self, max_edit: float) -> Plan:
        if max_edit not in self.plans:
            self.plans[max_edit] = Plan(self.texts, max_edit)
        return self.plans[max_edit]


def align(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``item`` to a piece of ``text`` and the piece's end
    (the first best one), if it is at most ``limit``: Myers' bit-parallel columns."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= limit else None


def may_align(item: str, text: str, limit: int) -> bool:
    """Whether ``limit`` edits leave enough q-grams of the item in the text: an edit
    takes q of them at most."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) for t in (item, text))
    gx, gy = x, y
    for q in (2, 3, 4):
        if len(x) < q:
            return True
        if len(y) < q:
            return len(x) - q + 1 <= q * limit
        gx, gy = gx[:-1] * np.uint64(1 << 21 | 1) + x[q - 1:], gy[:-1] * np.uint64(1 << 21 | 1) + y[q - 1:]
        if np.isin(gx, gy).sum() < len(gx) - q * limit:
            return False
    return True


def _one_edit(here: np.ndarray, onwards: np.ndarray, other: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether the packed text ``here`` (``onwards``: from the next character) begins
    with ``other`` but for one edit at most."""
    low, high, one = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080), np.uint64(1)
    x = (here ^ other) & mask
    z = ((x & low) + low | x) & high  # a bit for each byte that differs
    rest = ~(((z & (~z + one)) >> np.uint64(7)) - one)  # bytes from the first of them on
    return ((z & (z - one)) == 0) | ((onwards ^ other) & mask & rest == 0) | ((here ^ other >> np.uint64(8)) & mask >> np.uint64(8) & rest == 0)


def _leaf_hits(classes: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Places and leaves that occur there, the other leaf of the group beside them."""
    n = len(classes)
    words = np.concatenate([_packed(classes), [np.uint64(0)], _packed(classes[::-1]), [np.uint64(0)]])
    mask = np.uint64((1 << 8 * leaves.length) - 1)
    places, rows = [], []
    for low in range(0, n - leaves.length + 1, PLACES):
        word = words[low:min(low + PLACES, n - leaves.length + 1)] & mask
        slot = (word * K.MIX_GOLDEN >> leaves.shift).astype(np.int64)
        first = leaves.first[slot]
        count = leaves.first[slot + 1] - first
        some = np.flatnonzero(count)
        count = count[some]
        total = np.cumsum(count)
        if len(some) == 0:
            continue
        place = np.repeat(some + low, count)
        row = np.repeat(first[some] - (total - count), count) + np.arange(total[-1])
        back = leaves.back[row]
        at = np.where(back == 1, 2 * n + 2 - place, place + leaves.length)
        ok = np.flatnonzero(_one_edit(words[at], words[at + 1], leaves.other[row], leaves.mask[row]))
        places.append(place[ok])
        rows.append(row[ok])
    return np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*rows, np.zeros(0, np.int64)])


def _aligned(classes: np.ndarray, plan: Plan, node: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each node aligns with the text where it would begin at ``begin``, both
    sides as wide as its edits: Myers' columns of all places at once."""
    out = np.zeros(len(node), bool)
    padded = np.concatenate([classes & 63, np.zeros(1, np.uint8)]).astype(np.int64)
    one = np.uint64(1)
    for low in range(0, len(node), COLUMNS):
        used, of = np.unique(node[low:low + COLUMNS], return_inverse=True)
        _, where, length, edits = plan.nodes[:, used]
        masks = np.zeros((len(used), 64), np.uint64)
        for i in range(int(length.max())):
            rows = np.flatnonzero(length > i)
            masks[rows, plan.classes[where[rows] + i] & 63] |= one << np.uint64(i)
        masks, of = masks.ravel(), of.ravel()
        at, row = begin[low:low + COLUMNS] - edits[of], of * 64
        top = (length[of] - 1).astype(np.uint64)
        plus, minus = np.full(len(of), ~np.uint64(0)), np.zeros(len(of), np.uint64)
        score = length[of].copy()
        best = score.copy()
        for step in range(int((length + 2 * edits).max())):
            place = at + step
            eq = masks[row + padded[np.where((place < 0) | (place > len(classes)), len(classes), place)]]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            score += (ph >> top & one).astype(np.int64)
            score -= (mh >> top & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        out[low:low + COLUMNS] = best <= edits[of]
    return out


def _places(classes: np.ndarray, bounds: np.ndarray, plan: Plan) -> list[tuple[int, int, int, int]]:
    """``(document, item, begin, end)``: stretches of the slice that may hold a match,
    wide enough for it; those that overlap are one."""
    found = []
    for leaves in plan.leaves:
        place, row = _leaf_hits(classes, leaves)
        doc = np.searchsorted(bounds, place, "right") - 1
        inside = place + leaves.length <= bounds[doc + 1]
        place, row, doc = place[inside], row[inside], doc[inside]
        for nodes in leaves.nodes:
            begin = place - leaves.offset[row] + plan.nodes[0][nodes[row]]
            code, of = np.unique(nodes[row] << 32 | begin + (1 << 30), return_inverse=True)
            ok = _aligned(classes, plan, code >> 32, (code & (1 << 32) - 1) - (1 << 30))[of.ravel()]
            place, row, doc = place[ok], row[ok], doc[ok]
        item = leaves.item[row]
        start, limit = place - leaves.offset[row], plan.limit[item]
        found.append(np.stack([doc, item, np.maximum(start - limit, bounds[doc]), np.minimum(start + plan.size[item] + limit, bounds[doc + 1])]))
    full = np.flatnonzero(np.diff(bounds) > 0)
    found += [np.stack([full, np.full(len(full), i), bounds[full], bounds[full + 1]]) for i in plan.whole]
    out: list[tuple[int, int, int, int]] = []
    for d, i, a, b in sorted(zip(*np.concatenate([*found, np.zeros((4, 0), np.int64)], axis=1).astype(np.int64).tolist(), strict=True)):
        if out and out[-1][:2] == (d, i) and a <= out[-1][3]:
            out[-1] = (d, i, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((d, i, a, b))
    return out


def _matches(texts: pa.Array, items: Items, max_edit: float) -> list[tuple[int, int, int, int, int]]:
    """``(row, item, distance, start, end)``: the best place of each item in each text
    of a batch, as code points of the text."""
    plan = items.plan(max_edit)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in K.slices(texts, SLICE_BYTES):
        points = _code_points(part.data.tobytes().decode())
        offsets = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])[part.offsets]
        spaces = (points == 0x20) | (points >= 0x09) & (points <= 0x0D)
        keep = ~spaces
        keep[1:] |= ~spaces[:-1]
        keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
        source = np.flatnonzero(keep)
        points = np.where(spaces, np.uint32(0x20), points + ((points >= 65) & (points <= 90)) * np.uint32(32))[source]
        bounds = np.searchsorted(source, offsets)
        for d, i, a, b in _places(_classes(points), bounds, plan):
            item, text, limit = items.texts[i], points[a:b].tobytes().decode("utf-32-le"), int(plan.limit[i])
            found = align(item, text, limit) if may_align(item, text, limit) else None
            if found is not None:
                distance, stop = found
                back = align(item[::-1], text[:stop][::-1], limit)
                where = (distance, int(source[a + stop - back[1]] - offsets[d]), int(source[a + stop - 1] - offsets[d]) + 1)
                best[part.first + d, i] = min(best.get((part.first + d, i), where), where)
    return [(*k, *v) for k, v in best.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, id_col: str = ID, text_col: str = TEXT,
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, version, item_id, distance, start, end``: one row per document and
    item that occurs in it within ``max_edit`` of its length; ``start`` and ``end`` are
    code points of the text, ``version`` a hash of it.

    Null and empty texts hold nothing; items without text take no part, short ones do
    (below five characters no edit is within 0.2); repeated items are matched each, repeated rows give a row each. Empty
    tables give no rows; other columns are ignored."""
    rows = narrow(docs, id_col, text_col).withColumn("version", F.xxhash64(TEXT))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item"))
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    parts = []
    for b in range(blocks):
        # a block is a hash share of a stated query set, about BLOCK_BYTES of it
        block = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).collect()])
        block.plan(max_edit)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            if not index.ids:
                return
            found = _matches(batch.column(1), index, max_edit)
            if not found:
                return
            of = pa.array([f[0] for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(2).take(of), pa.array([index.ids[f[1]] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (3, 4))],
                names=[ID, "version", "item_id", "distance", "start", "end"])

        parts.append(arrow_map(rows, run, f"{ID} long, version long, item_id long, distance long, start long, end long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The input rows without the documents that hold a benchmark item."""
    bad = stored(leaks(docs, benchmark, max_edit, id_col, text_col).select(F.col(ID).alias("__id"), F.col("version").alias("__version")).distinct(), "leaks")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__version"))
    return docs.join(bad, same, "left_anti")
