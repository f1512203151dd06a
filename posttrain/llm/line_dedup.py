"""Line dedup by an exact set-similarity join (operator 6).

A line's tokens are its distinct words; every line with a word takes part, whatever
its length or script. Two lines match if 100 * common >= ``percent`` * union.
A line is removed if a line before it (by doc_id, then line number) matches it,
whether or not that one is removed itself, so the result has no order of work.

1. Token counts over all lines go into a sketch of fixed size; it orders tokens by
   rarity. Any order is exact, a good one is fast.
2. Equal token sets are one set, with its first place; all later places go.
3. Two sets that match share a token among their rarest ones (prefix filter). Sets
   so small that one token more or less is below ``percent`` match no other set; they
   have no prefix. Postings of prefix tokens that one set alone has are left out.
4. Sets meet all earlier sets of their tokens, behind length and position bounds and the
   parities of their tokens in 64 slots (256 for long sets), which differ in no more
   slots than the sets have different tokens; they lose nothing. The best candidate among
   the first sets of a set's tokens is its named match if it is one. Sets of a crowd (a
   large group of near copies, by the bounds) do not meet each other at first; those of
   them that this candidate does not settle then meet all earlier sets of the crowd's
   tokens. All that is left is verified on full token sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, give_back, in_bitmap, key_bitmap, narrow, release, stored
from posttrain.llm.set_check import verified

#: Lines without a word have nothing to compare.
MIN_TOKENS = 1
SKETCH_BITS = 18
#: Slots whose counts travel in one row.
SKETCH_ROW = 1 << 10
#: Bytes of text whose lines are cut at once; tens of bytes of arrays go with each.
SLICE_BYTES = 1 << 18
#: 64-bit words of the wide parities, which sets of more than ``LONG`` tokens have: those
#: of unrelated sets differ in half their slots, and 64 slots are too few to tell there.
PARITY_WORDS = 4
LONG = 64
#: Parts in which sets meet. No rounds of their own lead up to them.
ROUNDS = 2
LEADER_ROUNDS = 0
#: Sets of one token within bounds of one of its ``PIVOTS`` that make a crowd when more.
CROWD = 32
PIVOTS = 16
#: Postings of a bucket of tokens, more or less; those of a slot that are dealt over
#: several buckets; pairs that are compared at once.
BUCKET = 1 << 17
HOT = 1 << 15
PAIRS = 1 << 18
#: Parities in 64 slots (the wide words folded), and the wide words but the first.
_PARITY = ["parity", *(f"w{i}" for i in range(1, PARITY_WORDS))]


def _split(part: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a slice: its hash, its document's row, the number of its line in
    the document, and the number of its line among the slice's lines that have a word."""
    w = K.words(part)
    hashes = K.span_hashes(K.lower(part.data), w.starts, w.ends)
    if len(hashes) == 0:
        zero = np.zeros(0, np.int64)
        return hashes, zero, zero, zero
    breaks = np.cumsum(part.data == 0x0A, dtype=np.int64)
    doc = np.repeat(np.arange(len(part)), np.diff(w.first))
    line = breaks[w.starts]  # a word never starts at a break
    begin = np.where(part.offsets[:-1] > 0, breaks[np.maximum(part.offsets[:-1] - 1, 0)], 0)
    change = line + doc  # distinct for lines of different documents
    group = np.cumsum(np.concatenate([[False], change[1:] != change[:-1]]))
    return hashes, doc, line - begin[doc], group


def _line_tokens(part: K.Slice, ranks: np.ndarray | None):
    """Participating lines of a slice: document row, line number, flat distinct
    token hashes in order of rarity, range of each line. ``ranks`` orders the slots
    of the sketch; tokens of one slot follow their hashes."""
    hashes, doc, number, group = _split(part)
    if len(hashes) == 0:
        return doc, number, hashes, np.zeros(1, np.int64)
    place = hashes if ranks is None else ranks[_slots(hashes)] << np.uint64(64 - SKETCH_BITS) | hashes & np.uint64((1 << 64 - SKETCH_BITS) - 1)
    same_line = group[1:] == group[:-1]
    order = None
    if group[-1] < 1 << 18:  # line and most of the place in one word: a single sort
        order = np.argsort(group.astype(np.uint64) << np.uint64(46) | place >> np.uint64(18))
        at = place[order]
        if (same_line & (at[1:] < at[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((place, group))
        at = place[order]
    # the lines stay where they are, each one's words change places
    new = np.concatenate([[True], ~same_line | (at[1:] != at[:-1])])
    of, tokens = group[new], hashes[order[new]]
    n = np.bincount(of)
    word_at = np.flatnonzero(np.concatenate([[True], ~same_line]))
    use = n >= MIN_TOKENS
    out_first = np.concatenate([[0], np.cumsum(n[use])])
    return doc[word_at][use], number[word_at][use], tokens if use.all() else tokens[np.repeat(use, n)], out_first


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_SKETCH_SCHEMA = "part int, counts binary"


def _sketch_rows(total: np.ndarray) -> pa.RecordBatch:
    total = total.reshape(-1, SKETCH_ROW)
    used = np.flatnonzero(total.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[i].tobytes() for i in used], pa.binary())], names=["part", "counts"])


def _summed(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts; the driver gets one number a slot."""
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in rows.column("counts"))
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    got = rows.groupBy("part").applyInArrow(add, _SKETCH_SCHEMA).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, SKETCH_ROW)
    for part, counts in zip(got["part"].to_pylist(), got["counts"].to_pylist(), strict=True):
        sketch[part] = np.frombuffer(counts, np.int64)
    return sketch.ravel()


def token_sketch(rows: DataFrame) -> np.ndarray:
    """Counts of lines per token, hashed into ``2^SKETCH_BITS`` slots, over all
    rows. Every task adds up its own lines first, in rows of ``SKETCH_ROW`` slots; the
    driver gets one number a slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in K.slices(batch.column(1), SLICE_BYTES):
                hashes, _, _, group = _split(part)
                if len(hashes) == 0:
                    continue
                # a word of a line once: 46 bits of a hash of both, and the slot
                both = K.mix64(hashes + group.astype(np.uint64) * K.MIX_GOLDEN) << np.uint64(SKETCH_BITS) | hashes >> np.uint64(64 - SKETCH_BITS)
                both.sort()
                once = both[np.concatenate([[True], both[1:] != both[:-1]])]
                total += np.bincount((once & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(total))
        give_back()
        yield _sketch_rows(total)

    return _summed(rows.mapInArrow(run, _SKETCH_SCHEMA))


def _lines(rows: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """``doc_id, version, line, n, c, key, short, bits, parity, w1.., prefix`` of the
    participating lines; ``short`` is the first word of the key, ``bits`` has a bit for each
    token, the parities one for each slot with an odd number of tokens. ``c`` counts a slice's lines of the key at their
    first place and is 0 at the others, which have no prefix."""
    ranks = np.empty(len(sketch), np.uint64)
    ranks[np.argsort(sketch, kind="stable")] = np.arange(len(sketch), dtype=np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(ranks)  # fixed size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batch.column(1), SLICE_BYTES):
            doc, number, tokens, first = _line_tokens(part, shared.value)
            if len(doc) == 0:
                continue
            n = np.diff(first)
            key, of = K.set_keys(tokens, first), pa.array(doc + part.first)
            ids = batch.column(0).take(of)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            order = np.lexsort((number, ids.fill_null(0).to_numpy(), known, key[:, 1], key[:, 0]))
            lead = np.flatnonzero(np.concatenate([[True], (key[order[1:]] != key[order[:-1]]).any(axis=1)]))
            c = np.zeros(len(key), np.int64)
            c[order[lead]] = np.diff(np.append(lead, len(key)))
            size = np.where((100 * n < percent * (n + 1)) | (c == 0), 0, n - (percent * n + 99) // 100 + 1)
            out_first = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(first[:-1] - out_first[:-1], size) + np.arange(out_first[-1])
            bits = np.bitwise_or.reduceat(np.uint64(1) << (tokens & np.uint64(63)), first[:-1])
            place = tokens >> np.uint64(6)
            word, bit = place >> np.uint64(6) & np.uint64(PARITY_WORDS - 1), np.uint64(1) << (place & np.uint64(63))
            # short sets have zeros for wide words, which take next to no space
            bit_of_long = np.where(np.repeat(n > LONG, n), bit, np.uint64(0))
            parity = [np.bitwise_xor.reduceat(bit, first[:-1]),
                      *(np.bitwise_xor.reduceat(np.where(word == i, bit_of_long, np.uint64(0)), first[:-1]) for i in range(1, PARITY_WORDS))]
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2).take(of), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(c),
                 K.key_array(key), pa.array(key[:, 0].view(np.int64)), pa.array(bits.view(np.int64)),
                 *(pa.array(w.view(np.int64)) for w in parity), K.list_array(tokens[at].view(np.int64), out_first, pa.int64())],
                names=[ID, "version", "line", "n", "c", "key", "short", "bits", *_PARITY, "prefix"])

    words = ", ".join(f"{w} long" for w in _PARITY)
    return arrow_map(rows, run, f"{ID} long, version long, line int, n int, c long, key binary, short long, bits long, {words}, prefix array<long>")


def _token_sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, items`` (token hashes) of the sets in ``pairs``, cut again from the documents
    of their first places. Bitmaps of fixed size pass over other documents and lines; the
    join is exact."""
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(c).alias("key"), F.col(f"{c}_doc").alias("doc")) for c in "ab"))).alias("e")).select("e.*")
    docs, lines = key_bitmap(ends, F.xxhash64("doc")), key_bitmap(ends, F.expr("xxhash64(doc) ^ key"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch) == 0:
            return
        at_doc = batch.column(1).to_numpy()
        use = in_bitmap(docs, at_doc)
        at_doc = at_doc[use].view(np.uint64)
        for part in K.slices(batch.column(0).filter(pa.array(use)), SLICE_BYTES):
            doc, _, tokens, first = _line_tokens(part, None)
            key = K.set_keys(tokens, first)[:, 0]
            hit = np.flatnonzero(in_bitmap(lines, at_doc[doc + part.first] ^ key)) if len(key) else np.zeros(0, np.int64)
            hit = hit[np.unique(key[hit], return_index=True)[1]]
            if len(hit):
                size = np.diff(first)[hit]
                out_first = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(first[:-1][hit] - out_first[:-1], size) + np.arange(out_first[-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), K.list_array(tokens[at].view(np.int64), out_first, pa.int64())],
                                                 names=["key", "items"])

    found = arrow_map(rows.select(TEXT, F.xxhash64(ID).alias("at_doc")), run, "key long, items array<long>")
    return stored(found.join(ends.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "token_sets")


def _matches(rows: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """``a, b, b_doc`` of the pairs that match."""
    items = _token_sets(rows, pairs)
    out = stored(verified(pairs, items, percent, "b_doc"), name)
    release(items)
    return out


def prefix_counts(sets: DataFrame) -> np.ndarray:
    """Prefix tokens of the sets in each slot of the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_slots(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=len(total))
        yield _sketch_rows(total)

    return _summed(sets.select("prefix").mapInArrow(run, _SKETCH_SCHEMA))


def _by_token(sets: DataFrame, counts: np.ndarray, rounds: int, k: int, percent: int, only: tuple[np.ndarray, np.ndarray] | None = None) -> GroupedData:
    """The postings of the sets' prefix tokens of round ``k``, grouped by buckets of tokens.
    A row holds what a batch of sets has for a bucket, as an array of ``_posting`` records.

    ``asks``: the posting looks for others, ``told``: it is looked up (if it stands in the
    shorter set's prefix). With ``only``, bitmaps of sets and tokens, other tokens are left
    out and other sets are not ``open``; a false hit is only more work. Tokens in a slot of more than
    ``HOT`` postings are dealt over several buckets: each posting asks in one of them
    and is told in all, which know the token's first place."""
    kind = _posting()
    buckets = int(counts.sum()) // rounds // BUCKET + 1
    split = sets.sparkSession.sparkContext.broadcast(np.minimum(counts // HOT + 1, buckets))  # fixed size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch) == 0:
            return
        prefix = batch.column("prefix")
        token = prefix.flatten().to_numpy()
        size = pc.list_value_length(prefix).to_numpy()
        of = np.repeat(np.arange(len(batch)), size)
        at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        use = np.mod(token, rounds) == k
        if only is not None:
            use &= in_bitmap(only[1], token)
        use = np.flatnonzero(use)
        token, of, at = token[use], of[use], at[use]
        # null ids come first
        doc, line = batch.column("doc"), batch.column("line").to_numpy().astype(np.int64)
        null = doc.is_null().to_numpy(zero_copy_only=False)
        own = {"short": batch.column("short").to_numpy(), "n": batch.column("n").to_numpy(),
               "doc": doc.fill_null(np.iinfo(np.int64).min).to_numpy(), "line": np.where(null, line - (1 << 31), line),
               **{w: batch.column(w).to_numpy() for w in ("bits", *_PARITY)}}
        own["open"] = np.ones(len(batch), bool) if only is None else in_bitmap(only[0], own["short"])
        rec = np.empty(len(token), kind)
        rec["token"], rec["i"], rec["asks"] = token, at, True
        for name, values in own.items():
            rec[name] = values[of]
        n = rec["n"].astype(np.int64)
        rec["told"] = at < n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
        mixed, parts = K.mix64(token.view(np.uint64)), split.value[_slots(token.view(np.uint64))]
        deal = K.mix64(rec["short"].view(np.uint64)) % parts.astype(np.uint64)
        hot = np.flatnonzero((parts > 1) & rec["told"])
        rest = np.flatnonzero((parts > 1) & ~rec["told"])
        hot = np.concatenate([hot, rest[_firsts(rec[rest])]])  # a token's first place is known in all
        if len(hot):
            more = np.repeat(hot, parts[hot])
            part = np.arange(len(more)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
            copies = rec[more]
            copies["asks"] = False
            rec["told"][hot] = False
            rec, mixed, deal = np.concatenate([rec, copies]), np.concatenate([mixed, mixed[more]]), np.concatenate([deal, part.astype(np.uint64)])
        bucket = ((mixed + deal) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rec = bucket[order], rec[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else order
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array([x.tobytes() for x in np.split(rec, first[1:])] if len(first) else [], pa.binary())], names=["bucket", "postings"])

    return arrow_map(sets, run, "bucket int, postings binary").groupBy("bucket")


def _firsts(c) -> np.ndarray:
    """The postings that have the first places of their tokens, in order of token."""
    order = np.lexsort((c["short"], c["line"], c["doc"], c["token"]))
    token = c["token"][order]
    return order[np.concatenate([[True], token[1:] != token[:-1]])[:len(order)]]


def _posting() -> np.dtype:
    """A set's prefix token, ``i`` from the front; ``doc, line, short`` is its place."""
    return np.dtype([("token", "<i8"), ("short", "<i8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("i", "<i4"),
                     ("asks", "?"), ("told", "?"), ("open", "?"), *((w, "<u8") for w in ("bits", *_PARITY))])


def _columns(postings: pa.Table) -> dict[str, np.ndarray]:
    rec = np.frombuffer(b"".join(postings.column("postings").to_pylist()), _posting())
    return {name: rec[name].astype(np.int64) if name in ("line", "n", "i") else np.ascontiguousarray(rec[name]) for name in rec.dtype.names}


def _bounds(percent: int, n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length and position bounds of candidate pairs of ``n`` and ``m`` tokens; a true match
    passes them at its first common token, whose positions from 0 are ``i`` and ``j``."""
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - i, m - j) * (100 + percent) >= percent * (n + m))


def _apart(percent: int, slots: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Bound on the tokens that only one set of a pair has, given slots that differ: no
    more than those tokens."""
    return slots.astype(np.int64) * (100 + percent) <= (100 - percent) * (n + m)


def _led(percent: int, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings that ask, the best of the first sets of their sets' tokens within bounds, and
    how many ``bits`` of the two differ; a set once."""
    lead = _firsts(c)
    asks = np.flatnonzero(c["asks"])
    to = lead[np.searchsorted(c["token"][lead], c["token"][asks])]
    other = c["short"][asks] != c["short"][to]
    asks, to = asks[other], to[other]
    apart = np.bitwise_count(c["bits"][asks] ^ c["bits"][to])
    ok = _bounds(percent, c["n"][asks], c["i"][asks], c["n"][to], c["i"][to]) & _apart(percent, apart, c["n"][asks], c["n"][to])
    asks, to, apart = asks[ok], to[ok], apart[ok]
    order = np.lexsort((c["short"][to], apart, c["short"][asks]))
    a = c["short"][asks[order]]
    order = order[np.concatenate([[True], a[1:] != a[:-1]])[:len(order)]]
    return asks[order], to[order], apart[order].astype(np.int32)


def _near(percent: int, c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the sets of postings ``x`` and ``y`` are within the bounds of their parities."""
    n, m = c["n"][x], c["n"][y]
    ok = np.flatnonzero(_apart(percent, np.bitwise_count(c["parity"][x] ^ c["parity"][y]), n, m))
    far = ok[np.minimum(n[ok], m[ok]) > LONG]
    wide = [c[w][x[far]] ^ c[w][y[far]] for w in _PARITY]
    wide[0] = np.bitwise_xor.reduce(wide)  # the first wide word is not stored
    out = np.zeros(len(x), bool)
    out[ok] = True
    out[far] = _apart(percent, sum(np.bitwise_count(w).astype(np.int64) for w in wide), n[far], m[far])
    return out


def _ends(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The later (``a``) and the earlier posting (``b``) of pairs, each pair of sets once."""
    late = np.zeros(len(x), bool)
    for name in ("short", "line", "doc"):
        late = np.where(c[name][x] == c[name][y], late, c[name][x] > c[name][y])
    a, b = np.where(late, x, y), np.where(late, y, x)
    use = c["open"][a] & (c["short"][a] != c["short"][b])
    a, b = a[use], b[use]
    order = np.lexsort((c["short"][b], c["short"][a]))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (c["short"][a[1:]] != c["short"][a[:-1]]) | (c["short"][b[1:]] != c["short"][b[:-1]])
    return a[new], b[new]


def _crowds(percent: int, c: dict[str, np.ndarray], told: np.ndarray, crowd: int, pivots: int) -> np.ndarray:
    """The pivot of each posting that is one of more than ``crowd`` near one, -1 for others.
    ``told`` is in order of token."""
    token = c["token"][told]
    out = np.full(len(c["token"]), -1)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[:len(token)])
    size = np.diff(np.append(first, len(token)))
    first, size = first[size > crowd], size[size > crowd]
    if len(first) == 0:
        return out
    group = np.minimum(np.searchsorted(token[first], c["token"]), len(first) - 1)
    own = np.flatnonzero(token[first][group] == c["token"])
    group = group[own]
    for j in range(pivots):
        pivot = told[first + size * j // pivots][group]
        n, m = c["n"][own], c["n"][pivot]
        near = np.flatnonzero((np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (out[own] < 0))
        near = near[_near(percent, c, own[near], pivot[near])]
        near = near[np.bincount(group[near], minlength=len(first))[group[near]] > crowd]
        out[own[near]] = pivot[near]
    return out


def _meet(c: dict[str, np.ndarray], asks: np.ndarray, told: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (see ``_ends``) of postings ``asks`` and ``told``, those in order of
    token and ``n``."""
    token = c["token"][told]
    new = np.concatenate([[True], token[1:] != token[:-1]])[:len(token)]
    known, place = token[new], (np.cumsum(new) - 1 << 32) + c["n"][told]
    group = np.searchsorted(known, c["token"][asks])
    has = group < len(known)
    has[has] = known[group[has]] == c["token"][asks[has]]
    asks, group = asks[has], group[has]
    n = c["n"][asks]
    low = np.searchsorted(place, (group << 32) + (n * percent + 99) // 100)
    count = np.searchsorted(place, (group << 32) + n, "right") - low
    end = np.cumsum(count)
    at = 0
    while at < len(asks):  # a bounded number of pairs at a time
        begin = end[at] - count[at]
        stop = max(at + 1, int(np.searchsorted(end, begin + PAIRS, "right")))
        x = np.repeat(asks[at:stop], count[at:stop])
        y = told[np.arange(len(x)) + np.repeat(low[at:stop] - (end[at:stop] - count[at:stop] - begin), count[at:stop])]
        at = stop
        near = _near(percent, c, x, y)  # most pairs end there
        x, y = x[near], y[near]
        ok = _bounds(percent, c["n"][x], c["i"][x], c["n"][y], c["i"][y])
        yield _ends(c, x[ok], y[ok])


_MET_SCHEMA = "a long, a_doc long, b long, b_doc long, h int, near boolean"


def _met(percent: int, crowd: int = 0, pivots: int = 0) -> Callable[[pa.Table], pa.Table]:
    """``a, a_doc, b, b_doc``: open sets and earlier sets of their tokens, within bounds. The
    longer set of a pair has one of its prefix tokens among the few of the shorter one's.

    With ``pivots``, sets of a crowd do not meet each other; they have a row without ``b``
    that has the token for ``b_doc``. And rows with ``h`` have what ``_led`` gives; ``near``:
    the pair is within the other bounds too."""
    def run(postings: pa.Table) -> pa.Table:
        c = _columns(postings)
        asks, told, settled = np.flatnonzero(c["asks"]), np.flatnonzero(c["told"]), ~c["open"]
        told = told[np.lexsort((c["short"][told], c["n"][told], c["token"][told]))]

        def doc(at: np.ndarray) -> pa.Array:
            return pa.array(c["doc"][at], pa.int64(), mask=c["line"][at] < 0)

        def rows(a: np.ndarray, b: pa.Array, b_doc: pa.Array, h: pa.Array, near: pa.Array) -> pa.Table:
            return pa.table({"a": c["short"][a], "a_doc": doc(a), "b": b, "b_doc": b_doc, "h": h, "near": near})

        out = []
        if pivots:
            settled = _crowds(percent, c, told, crowd, pivots) >= 0
            own = np.flatnonzero(settled)
            none = len(own)
            out.append(rows(own, pa.nulls(none, pa.int64()), pa.array(c["token"][own]), pa.nulls(none, pa.int32()), pa.nulls(none, pa.bool_())))
            a, b, h = _led(percent, c)
            out.append(rows(a, pa.array(c["short"][b]), doc(b), pa.array(h), pa.array(_near(percent, c, a, b))))
        # settled sets need not meet each other
        met = [*_meet(c, asks[~settled[asks]], told, percent), *_meet(c, asks[settled[asks]], told[~settled[told]], percent)]
        none = np.zeros(0, np.int64)
        a, b = _ends(c, np.concatenate([none, *(x for x, _ in met)]), np.concatenate([none, *(y for _, y in met)]))
        out.append(rows(a, pa.array(c["short"][b]), doc(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.bool_())))
        return pa.concat_tables(out)

    return run


def distinct_sets(lines: DataFrame) -> DataFrame:
    """The distinct token sets of the lines, with their first places. Slices have added up
    their lines, so the rest is grouped after the shuffle only."""
    sets = lines.where("c > 0").repartition(F.col("key")).groupBy("key").agg(
        F.min(F.struct(F.col(ID).alias("doc"), "line")).alias("place"), F.first("short").alias("short"), F.first("n").alias("n"),
        *(F.first(w).alias(w) for w in ("bits", *_PARITY)), F.first("prefix").alias("prefix"), F.sum("c").alias("c"))
    return stored(sets.select("c", "place", "short", "n", "bits", *_PARITY, "prefix"), "line_sets")


def matched_sets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct sets that an earlier set matches (``short, by, by_doc``). A set is known
    by ``short``, a 64-bit hash, as words are."""
    counts = prefix_counts(sets)
    posted = sets.select("short", F.col("place.doc").alias("doc"), F.col("place.line").alias("line"), "n", "bits", *_PARITY, "prefix")
    ends = ["a", "a_doc", "b", "b_doc"]
    # in a few rounds, so that only a share of the postings is on disk at a time
    told = [stored(_by_token(posted, counts, ROUNDS, k, percent).applyInArrow(_met(percent, CROWD, PIVOTS), _MET_SCHEMA), "met")
            for k in range(ROUNDS)]
    rounds = [stored(t.where("h IS NULL").select(*ends).distinct(), "met_pairs") for t in told]
    best = (reduce(DataFrame.union, told).where("h IS NOT NULL").groupBy("a").agg(F.min(F.struct("h", "b", "b_doc", "near", "a_doc")).alias("p"))
            .where("p.near").select("a", "p.a_doc", "p.b", "p.b_doc"))
    best = stored(best, "first_pairs")
    met = reduce(DataFrame.union, rounds)
    pairs = stored(met.where("b IS NOT NULL").union(best).distinct(), "pairs")
    found = _matches(rows, pairs, percent, "matches")
    led = found.join(best.select("a", "b"), ["a", "b"], "left_semi")
    crowd = stored(met.where("b IS NULL").select("a", F.col("b_doc").alias("token")).join(led, "a", "left_anti"), "crowd")
    release(*told, *rounds)
    if not crowd.isEmpty():  # sets of crowds that are still open meet all earlier sets of the crowds' tokens
        only = key_bitmap(crowd, F.col("a")), key_bitmap(crowd, F.col("token"))
        more = _by_token(posted, counts, 1, 0, percent, only).applyInArrow(_met(percent), _MET_SCHEMA).select(*ends).distinct()
        more = stored(more.join(pairs, ["a", "b"], "left_anti"), "other_pairs")
        found = found.union(_matches(rows, more, percent, "other_matches"))
        release(more)
    release(pairs, crowd)
    first = best.select("a", "b", F.lit(False).alias("other"))
    return (found.join(first, ["a", "b"], "left").groupBy(F.col("a").alias("short"))
            .agg(F.min(F.struct(F.coalesce("other", F.lit(True)).alias("other"), "b", "b_doc")).alias("p"))
            .select("short", F.col("p.b").alias("by"), F.col("p.b_doc").alias("by_doc")))


def dropped_lines(docs: DataFrame, percent: int = 80, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, version, lines array<int>, seen_in array<long>``: the line numbers
    (from 0) to remove from each text that loses any, and the documents that have
    the first places of their matches. ``version`` is a hash of the text, so rows
    that repeat an id with another text are told apart."""
    rows = narrow(docs, id_col, text_col).withColumn("version", F.xxhash64(TEXT))
    wide = stored(_lines(rows, token_sketch(rows), percent), "lines")
    sets = distinct_sets(wide)
    # from here on only the places of the lines are needed
    lines = stored(wide.select("short", ID, "version", "line"), "line_places")
    release(wide)
    found = matched_sets(rows, sets, percent)
    # a line goes if its set has a match, or an earlier place
    known = (sets.where("c > 1").select("short", "place").join(found, "short", "full")
             .select("short", "place", F.col("by").isNotNull().alias("late"),
                     F.when(F.col("by").isNull(), F.col("place.doc")).otherwise(F.col("by_doc")).alias("by_doc")))
    gone = (lines.join(known.hint("shuffle_hash"), "short")
            .where(F.col("late") | ~F.struct(F.col(ID).alias("doc"), "line").eqNullSafe(F.col("place"))))
    out = stored(gone.groupBy(ID, "version").agg(F.array_sort(F.collect_set("line")).alias("lines"),
                                                 F.array_sort(F.collect_set("by_doc")).alias("seen_in")), "dropped_lines")
    release(lines, sets)
    return out


def line_dedup(docs: DataFrame, percent: int = 80, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The input rows with ``text`` without its removed lines, and ``dropped_lines
    array<int>``, ``seen_in array<long>``.

    Lines are what newlines separate; of a text that loses lines the others are
    joined again, and a text that loses none stays as it is (null stays null). The
    order of lines is by doc_id (nulls first), then line number; rows that repeat
    both id and text share one decision. Input columns of the added names are
    replaced. An empty table gives no rows."""
    gone = dropped_lines(docs, percent, id_col, text_col).select(
        F.col(ID).alias("__id"), F.col("version").alias("__version"), F.col("lines").alias("__lines"), F.col("seen_in").alias("__seen"))
    gone = gone.hint("shuffle_hash")  # a short row for each text that loses lines; the texts need no sort
    names = [c for c in docs.columns if c not in ("dropped_lines", "seen_in")]
    body = F.col(text_col).cast("string")
    joined = docs.select(*names).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__version")), "left")
    # a map of line numbers makes the test of each line one lookup
    kept = F.array_join(F.transform(F.filter(
        F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda e: ~F.array_contains("__lines", e["i"])), lambda e: e["x"]), "\n")
    text = F.when(F.col("__lines").isNull(), body).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in names),
                         F.coalesce("__lines", F.array().cast("array<int>")).alias("dropped_lines"),
                         F.coalesce("__seen", F.array().cast("array<long>")).alias("seen_in"))
