"""Substring dedup by automata of recurring phrases (operator 11).

A window is ``window`` consecutive words of one document. Every word covered by a
window whose word sequence also starts in a document with a smaller id goes.

1. Of the ``ANCHOR``-word phrases inside a window the one with the smallest hash is
   its anchor, so equal windows have equal anchors, wherever they stand. One scan
   gives the distinct anchors of each document; those of two documents or more are
   kept with the smallest document (a sum before the shuffle, one row a task for the
   most frequent phrase).
2. Documents with such anchors are cut into segments: the words of consecutive
   windows with one anchor.
3. Recurring passages are confirmed on the words themselves. Where all segments of
   an anchor are equal the segment is a passage; else each of its windows is looked
   at. A passage is kept with the smallest document it stands in, if there are two.
4. Passages are dealt out by anchor. Each shard compiles its passages to an
   Aho-Corasick automaton over a local alphabet (a character for each word, so equal
   characters are equal words) and streams its segments through it. A shard with
   many segments is split and its passages repeated; an anchor with more than
   ``PATTERNS`` passages is dealt out by window. So an automaton has a bounded size,
   segments are never held, and no document meets a shard it shares nothing with.
5. The matched word ranges of each document are joined to its text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, in_bitmap, key_bitmap, narrow, release, stored

#: Words of an anchor phrase.
ANCHOR = 6
#: Passages that one anchor may bring into a shard.
PATTERNS = 4096
#: Passages of a shard on average: so small an automaton stays in a core's cache.
SHARD = 1024
#: Segments that one split of a shard streams, on average.
SEGMENTS = 50_000
#: Bits of the bitmap that keeps anchors of one document out of a join (4 MB).
FILTER_BITS = 25


def _phrases(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on (the last ones run on)."""
    padded = np.concatenate([word_hash, np.zeros(width - 1, np.uint64)])
    total = word_hash.copy()
    for j in range(1, width):
        total = total * K.MIX_GOLDEN + padded[j:j + len(word_hash)]
    return K.mix64(total)


def _window_anchors(part: K.Slice, window: int) -> tuple[K.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice; document, first word and anchor of each window."""
    w = K.words(part)
    n_words = np.diff(w.first)
    count = np.maximum(n_words - window + 1, 0)
    doc = np.repeat(np.arange(len(part)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = w.first[:-1][doc] + np.arange(len(doc)) - begin[doc]
    if len(at) == 0:
        return w, doc, at, np.zeros(0, np.uint64)
    phrase = _phrases(K.span_hashes(part.data, w.starts, w.ends), min(ANCHOR, window))
    low = phrase[at]
    for j in range(1, window - min(ANCHOR, window) + 1):
        np.minimum(low, phrase[at + j], out=low)
    return w, doc, at, low


def _runs(doc: np.ndarray, anchor: np.ndarray, longest: int) -> np.ndarray:
    """Starts of the runs of windows of one document and anchor; a run of over
    ``longest`` windows (a phrase that repeats itself) is cut."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])
    starts = np.flatnonzero(new)
    since = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    return np.flatnonzero(since % longest == 0)


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, version, anchors``: distinct anchors of each document."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batch.column(1)):
            _, doc, _, anchor = _window_anchors(part, window)
            if len(doc) == 0:
                continue
            at = _runs(doc, anchor, len(doc))
            values, first = K.distinct_per_group(anchor[at], np.searchsorted(doc[at], np.arange(len(part) + 1)))
            has = np.flatnonzero(np.diff(first))
            of = pa.array(has + part.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(2).take(of), K.list_array(values.view(np.int64), first[np.append(has, len(part))], pa.int64())],
                names=[ID, "version", "anchors"])

    return arrow_map(rows, run, f"{ID} long, version long, anchors array<long>")


def _marked(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id, version, early, late``: the anchors that a document shares; ``late``
    ones also stand in a smaller document. A bitmap of fixed size keeps most other
    anchors out of the join, which is exact."""
    bits = key_bitmap(shared, F.col("anchor"), FILTER_BITS)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(2)
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        hit = np.flatnonzero(in_bitmap(bits, flat.to_numpy().view(np.uint64)))
        of = pa.array(np.repeat(np.arange(len(batch)), counts)[hit])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), flat.take(pa.array(hit))],
                                         names=[ID, "version", "anchor"])

    likely = arrow_map(found, run, f"{ID} long, version long, anchor long")
    late = F.col("first_id") < F.col(ID)
    return (likely.join(shared, "anchor").groupBy(ID, "version")
            .agg(F.collect_list(F.when(~late, F.col("anchor"))).alias("early"), F.collect_list(F.when(late, F.col("anchor"))).alias("late")))


def _segments(rows: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """``anchor, doc_id, version, at, late, segment``: ``at`` is the number of the
    segment's first word, ``segment`` its words joined by one space."""
    longest = 2 * (window - min(ANCHOR, window) + 1)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = [(np.asarray(c.flatten()).view(np.uint64), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(3), batch.column(4))]
        for part in K.slices(batch.column(1)):
            end = part.first + len(part)
            # what is shared is shared everywhere, so a slice's marks can be put together
            early, late = (flat[off[part.first]:off[end]] for flat, off in marks)
            w, doc, at, anchor = _window_anchors(part, window)
            if len(doc) == 0:
                continue
            starts = _runs(doc, anchor, longest)
            stops = np.append(starts[1:], len(doc)) - 1
            is_late = np.isin(anchor[starts], late)
            use = np.flatnonzero(is_late | np.isin(anchor[starts], early))
            starts, stops, is_late = starts[use], stops[use], is_late[use]
            if len(starts) == 0:
                continue
            place, body = _joined(part, w)
            left, right = place[at[starts]], place[at[stops] + window] - 1
            texts = [body[a:b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            of = pa.array(doc[starts] + part.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[starts].view(np.int64)), batch.column(0).take(of), batch.column(2).take(of),
                 pa.array((at[starts] - w.first[:-1][doc[starts]]).astype(np.int32)), pa.array(is_late),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                names=["anchor", ID, "version", "at", "late", "segment"])

    body = rows.join(marked, [ID, "version"]).select(ID, TEXT, "version", "early", "late")
    return arrow_map(body, run, f"anchor long, {ID} long, version long, at int, late boolean, segment string")


def _joined(part: K.Slice, w: K.Spans) -> tuple[np.ndarray, bytes]:
    """The words of a slice with one space after each, and where each one starts."""
    size = w.ends - w.starts
    place = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.zeros(len(part.data) + 1, np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    body = np.full(place[-1], 0x20, np.uint8)
    body[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = part.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return place, body.tobytes()


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """``i, passage``: each row's windows in place of its ``segment``."""
    cut = F.expr(f"transform(sequence(0, size(words) - {window}), i -> array_join(slice(words, i + 1, {window}), ' '))")
    return (rows.withColumn("words", F.split("segment", " ")).select("*", F.posexplode(cut).alias("i", "passage")).drop("words", "segment"))


def _passages(segments: DataFrame, window: int) -> DataFrame:
    """``anchor, passage, first_id, many``: word sequences of two documents or more."""
    ends = [F.min(ID).alias("first_id"), F.max(ID).alias("last_id")]
    distinct = stored(segments.groupBy("anchor", "segment").agg(*ends), "distinct_segments")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    told = distinct.join(kinds, "anchor")
    whole = told.where("kinds = 1").select("anchor", F.col("segment").alias("passage"), "first_id", "last_id")
    cut = (_windows(told.where("kinds > 1"), window)
           .groupBy("anchor", "passage").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")))
    out = stored(whole.unionByName(cut).where("first_id < last_id").drop("last_id"), "passages")
    release(distinct)
    return out


class _Shard:
    """Automaton of a shard's passages over one character for each of their words."""

    def __init__(self) -> None:
        self.letters: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        self.ready = False

    def add(self, passage: str, first_id: int) -> None:
        letters = self.letters
        word = passage.split(" ")
        for x in word:
            if x not in letters:
                n = len(letters) + 1
                letters[x] = chr(n if n < 0xD800 else n + 0x800)  # not the surrogates
        self.automaton.add_word("".join([letters[x] for x in word]), (len(word), first_id))

    def ranges(self, segment: str, doc_id: int) -> list[tuple[int, int]]:
        """Merged word ranges of the passages that a smaller document has."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        get = self.letters.get
        out: list[tuple[int, int]] = []
        for end, (size, first_id) in self.automaton.iter("".join([get(x) or "\0" for x in segment.split(" ")])):
            if first_id < doc_id:
                a = end + 1 - size
                while out and out[-1][1] >= a:
                    a = min(a, out.pop()[0])
                out.append((a, end + 1))
        return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard, split, passages first: one automaton at a time."""
    now, shard = None, _Shard()
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        numbers = [batch.column(i).to_numpy().tolist() for i in range(6)]
        for no, split, kind, doc_id, version, at, text in zip(*numbers, batch.column(6).to_pylist(), strict=True):
            if (no, split) != now:
                now, shard = (no, split), _Shard()
            if kind == 0:
                shard.add(text, doc_id)
            elif shard.letters:
                for a, b in shard.ranges(text, doc_id):
                    out.append((doc_id, version, at + a, at + b))
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                                         names=[ID, "version", "from", "to"])


def _located(segments: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """``doc_id, version, from, to``: word ranges to remove, found by the automata."""
    spark = segments.sparkSession
    per = passages.groupBy("anchor").agg(F.count("*").alias("n"))
    wide = stored(per.where(F.col("n") > PATTERNS).select("anchor", F.lit(True).alias("wide")), "wide_anchors")
    shards = passages.count() // SHARD + 1

    def dealt(rows: DataFrame, text: str) -> DataFrame:
        key = F.when(F.col("wide"), F.xxhash64("anchor", text)).otherwise(F.col("anchor"))
        return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))

    pieces = segments.where("late").select("anchor", ID, "version", "at", "segment").join(wide, "anchor", "left")
    alone = (_windows(pieces.where("wide"), window).withColumn("at", (F.col("at") + F.col("i")).cast("int"))
             .drop("i").withColumnRenamed("passage", "segment"))
    pieces = dealt(pieces.where("wide IS NULL").unionByName(alone), "segment")
    patterns = dealt(passages.join(wide, "anchor", "left"), "passage")
    splits = pieces.groupBy("shard").agg((F.floor(F.count("*") / SEGMENTS) + 1).cast("int").alias("splits"))
    splits = stored(splits, "shard_splits")
    texts = (pieces.join(splits, "shard").withColumn("split", F.pmod(F.xxhash64(ID, "at"), F.col("splits")).cast("int"))
             .select("shard", "split", F.lit(1).alias("kind"), ID, "version", "at", F.col("segment").alias("text")))
    words = (patterns.join(splits, "shard").withColumn("split", F.explode(F.expr("sequence(0, splits - 1)")))
             .select("shard", "split", F.lit(0).alias("kind"), F.col("first_id").alias(ID), F.lit(0).cast("long").alias("version"),
                     F.lit(0).alias("at"), F.col("passage").alias("text")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = words.unionByName(texts).repartition(parts, "shard", "split").sortWithinPartitions("shard", "split", "kind")
    return order.mapInArrow(_stream, f"{ID} long, version long, `from` int, `to` int")


def repeated_ranges(docs: DataFrame, window: int = 13, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, version, ranges array<struct<from, to>>``: the word numbers (from 0,
    end exclusive) to remove from each document that loses any. ``version`` is a
    hash of the text, so rows that repeat an id with another text are told apart."""
    rows = narrow(docs, id_col, text_col).where(f"{ID} IS NOT NULL").withColumn("version", F.xxhash64(TEXT))
    found = stored(_anchor_rows(rows, window), "anchors")
    shared = stored(found.select(ID, F.explode("anchors").alias("anchor")).groupBy("anchor")
                    .agg(F.min(ID).alias("first_id"), F.max(ID).alias("last_id")).where("first_id < last_id").drop("last_id"), "shared_anchors")
    marked = stored(_marked(found, shared), "marked")
    release(found, shared)
    # rows that repeat id and text are cut once
    segments = stored(_segments(rows, marked, window), "segments")
    release(marked)
    passages = _passages(segments, window)
    ranges = stored(_located(segments, passages, window).groupBy(ID, "version")
                    .agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("ranges")), "ranges")
    release(segments, passages)
    return ranges


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, n_words, n_removed, ranges, text``: one row per input row, ``text``
    the words that stay, joined by one space, ``ranges`` the removed word ranges.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text has no words;
    texts of fewer than ``window`` words lose none. Only a strictly smaller id makes
    a repeat, so rows that share an id do not touch each other, and rows without an
    id neither lose words nor make others lose them. An empty table gives no rows;
    other columns are left out, whatever their names."""
    ranges = repeated_ranges(docs, window, id_col, text_col)
    rows = narrow(docs, id_col, text_col).withColumn("version", F.xxhash64(TEXT))
    body = rows.join(ranges, [ID, "version"], "left").select(ID, TEXT, "ranges")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, gone, texts = [], [], []
        for text, spans in zip(batch.column(1).fill_null("").cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            kept, at = [], 0
            for r in spans or ():
                kept += words[at:r["from"]]
                at = max(at, r["to"])
            kept += words[at:]
            gone.append(len(words) - len(kept))
            texts.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column(2),
                                          pa.array(texts, pa.binary()).cast(pa.string())], names=[ID, "n_words", "n_removed", "ranges", TEXT])

    return arrow_map(body, run, f"{ID} long, n_words long, n_removed long, ranges array<struct<`from`: int, `to`: int>>, {TEXT} string")
