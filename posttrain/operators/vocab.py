"""T12 over a vocabulary: dense ids built by Spark, texts to ids and back.

Texts are cut into pieces that cover them without a gap, so ids to text is an exact
inverse for texts whose pieces are all in the vocabulary. Nearly all occurrences are of few
pieces: those with the ids up to ``HEAD`` (ids follow falling counts) go to every task,
which looks them up in place. A text meets the rest of the vocabulary, however large, in
a join, once for each distinct rare piece."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType

from posttrain.operators.index import global_index

#: Id of a piece that is not in the vocabulary; pieces have ids from 1 on.
UNKNOWN_ID = 0
# fixed value: a piece is a run of blanks, of word characters ([0-9A-Za-z_]), or of anything else
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"]] = 1
#: Pieces that are sent to every task: how many at most, and bytes of each.
HEAD, HEAD_BYTES = 1 << 17, 256
#: Bytes of texts or ids that a task takes at a time.
SLICE_BYTES = 4 << 20


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of pieces of each text (UTF-8 bytes), and all pieces in order, without a
    copy; a null text has none."""
    texts = pa.concat_arrays([texts.cast(pa.binary()).fill_null(b"")])
    ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64))
    if not ends[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.binary())
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:first + ends[-1]]
    kind = _KIND[data]
    begins = np.append(True, kind[1:] != kind[:-1])
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    cuts = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
    return np.diff(np.searchsorted(at, ends)), pa.Array.from_buffers(pa.binary(), len(at), [None, cuts, pa.py_buffer(data)])


def build_vocabulary(texts: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """``piece, id, n``: pieces that occur ``min_count`` times at least, with ids
    1, 2, ... by falling count, then by the piece itself. Counts are summed before the
    shuffle and ids come from bucketed positions, so no task sees all pieces."""
    def sums(batches):
        for part in _slices(batches, _text_ends):
            found = pieces(part["__text"])[1].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])

    rows = texts.select(F.col(text_col).cast("binary").alias("__text")).mapInArrow(sums, "piece binary, n long")
    counts = (rows.groupBy(F.col("piece").cast("string").alias("piece")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    order = global_index(counts.withColumn("__neg", -F.col("n")), "__neg", tiebreak=["piece"], out="id")
    return order.select("piece", (F.col("id") + 1).alias("id"), "n")


def _head(vocabulary: DataFrame) -> Broadcast:
    """``piece, id`` of the frequent pieces, as an Arrow table in every task."""
    short = F.col("id").between(1, HEAD) & (F.octet_length("piece") <= HEAD_BYTES)
    rows = vocabulary.where(short).select("piece", F.col("id").cast("long").alias("id")).toArrow()
    return vocabulary.sparkSession.sparkContext.broadcast(rows.combine_chunks())


def _slots(head: Broadcast) -> tuple[pa.Array, np.ndarray]:
    """The frequent pieces, and for each id up to ``HEAD`` its place among them or -1."""
    slots = np.full(HEAD + 1, -1)
    slots[head.value["id"].to_numpy()] = np.arange(head.value.num_rows)
    return pa.concat_arrays([pa.array([], pa.string()), *head.value["piece"].cast(pa.string()).chunks]), slots


def _slices(batches: Iterable[pa.RecordBatch], ends: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_BYTES``, one at least; ``ends``: bytes up to the end of each row."""
    for batch in batches:
        end, start = ends(batch), 0
        while start < batch.num_rows:
            limit = (end[start - 1] if start else 0) + SLICE_BYTES
            stop = max(start + 1, int(np.searchsorted(end, limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the Python worker outlives its task


def _text_ends(batch: pa.RecordBatch) -> np.ndarray:
    return np.cumsum(pc.binary_length(batch["__text"]).fill_null(0).to_numpy(), dtype=np.int64)


def _id_ends(batch: pa.RecordBatch) -> np.ndarray:
    return 8 * np.cumsum(_sizes(batch["__ids"]))


def _body_ends(batch: pa.RecordBatch) -> np.ndarray:
    lengths = pc.binary_length(batch["__segments"].flatten()).to_numpy()
    return np.append(0, np.cumsum(lengths, dtype=np.int64))[np.cumsum(_sizes(batch["__segments"]))]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _out(batch: pa.RecordBatch, keys: list[str], **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns.values()], [*keys, *columns])


def _looked_up(items: pa.Array, known: pa.Array, ids: pa.Array) -> np.ndarray:
    """The id of each item, ``UNKNOWN_ID`` for those that are not ``known``."""
    distinct = known.cast(pa.binary())
    at = pc.index_in(items, value_set=distinct.combine_chunks() if isinstance(distinct, pa.ChunkedArray) else distinct)
    return pc.fill_null(ids.take(at), UNKNOWN_ID).to_numpy().astype(np.int64)


def _schema(df: DataFrame, keys: list[str], **columns: DataType) -> StructType:
    return StructType([*(df.schema[k] for k in keys), *(StructField(n, t) for n, t in columns.items())])


def _with_rare(rows: DataFrame, rare: DataFrame, vocabulary: DataFrame, key: str, value: str, keys: list[str]) -> DataFrame:
    """``rows`` with ``__rare``: what the vocabulary has for the items ``__k`` of ``rare``
    that stand beside the same keys (null keys are keys like others)."""
    named = vocabulary.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where("__v IS NOT NULL")
    found = (rare.join(named, "__k").groupBy(*(F.col(k).alias(f"__of_{k}") for k in keys))
             .agg(F.collect_list(F.struct("__k", "__v")).alias("__rare")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    return rows.join(found, same, "left").select(*rows.columns, "__rare")


def encode(texts: DataFrame, vocabulary: DataFrame, keys: list[str], text_col: str = "text",
           max_length: int | None = None, out: str = "ids") -> DataFrame:
    """``keys`` (which name a row) and ``ids array<long>``: the ids of the text's pieces,
    cut after ``max_length``. Pieces outside the vocabulary get ``UNKNOWN_ID``; null and
    empty texts an empty list. ``vocabulary`` is read when the plan is built (its frequent
    part) and when it runs."""
    rows = texts.select(*keys, F.col(text_col).cast("binary").alias("__text"))
    head = _head(vocabulary)

    def cut(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Pieces of each text, all pieces, and their ids (0: not a frequent one)."""
        sizes, found = pieces(part["__text"])
        if max_length is not None:
            place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sizes, found = np.minimum(sizes, max_length), found.filter(pa.array(place < max_length))
        return sizes, found, _looked_up(found, head.value["piece"], head.value["id"])

    def rare(batches):
        for part in _slices(batches, _text_ends):
            sizes, found, ids = cut(part)
            left = pa.array(np.flatnonzero(ids == UNKNOWN_ID))
            codes = found.take(left).dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), sizes)[left.to_numpy()]
            pairs = np.unique(row * len(codes.dictionary) + codes.indices.to_numpy()) if len(left) else np.zeros(0, np.int64)
            rows, items = np.divmod(pairs, max(1, len(codes.dictionary)))
            yield _out(part.select(keys).take(pa.array(rows)), keys, __k=codes.dictionary.take(pa.array(items)))

    def ids(batches):
        for part in _slices(batches, _text_ends):
            sizes, found, ids = cut(part)
            left = np.flatnonzero(ids == UNKNOWN_ID)
            other = part["__rare"].flatten()
            ids[left] = _looked_up(found.take(pa.array(left)), other.field("__k"), other.field("__v"))
            yield _out(part, keys, **{out: _lists(sizes, pa.array(ids))})

    items = rows.mapInArrow(rare, _schema(rows, keys, __k=BinaryType())).withColumn("__k", F.col("__k").cast("string"))
    return _with_rare(rows, items, vocabulary, "piece", "id", keys).mapInArrow(ids, _schema(rows, keys, **{out: ArrayType(LongType())}))


def decode(encoded: DataFrame, vocabulary: DataFrame, keys: list[str], ids_col: str = "ids",
           unknown: str = "", out: str = "text") -> DataFrame:
    """``keys`` and the text of the ids; an id without a piece gives ``unknown``. Lists go
    through the join as segments of text with the rare ids between them."""
    rows = encoded.select(*keys, F.col(ids_col).cast("array<long>").alias("__ids"))
    head = _head(vocabulary)

    def places(part: pa.RecordBatch, slots: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each id of the part, its row, its place among the frequent pieces, and whether
        it is a rare one."""
        ids = part["__ids"].flatten().fill_null(UNKNOWN_ID).to_numpy()
        at = slots[np.where((ids > 0) & (ids <= HEAD), ids, 0)]
        return ids, np.repeat(np.arange(part.num_rows), _sizes(part["__ids"])), at, (at < 0) & (ids != UNKNOWN_ID)

    def rare(batches):
        slots = _slots(head)[1]
        for part in _slices(batches, _id_ends):
            ids, row, _, hole = places(part, slots)
            pairs = np.unique(np.stack([row[hole], ids[hole]]), axis=1)
            yield _out(part.select(keys).take(pa.array(pairs[0])), keys, __k=pa.array(pairs[1]))

    def segments(batches):
        words, slots = _slots(head)
        words = pa.concat_arrays([words, pa.array([unknown, ""])])
        for part in _slices(batches, _id_ends):
            ids, row, at, hole = places(part, slots)
            at = np.where(hole, len(words) - 1, np.where(at < 0, len(words) - 2, at))
            holes = np.flatnonzero(hole)
            # a segment begins with each row and after each hole, which itself is empty text
            first = np.append(0, np.cumsum(_sizes(part["__ids"])))[:-1]
            begin, of = np.append(first, holes + 1), np.append(np.arange(part.num_rows), row[holes])
            begin = begin[np.lexsort((begin, of))]
            parts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), words.take(pa.array(at)))
            n = np.bincount(row[holes], minlength=part.num_rows)
            yield _out(part, keys, __segments=_lists(n + 1, pc.binary_join(parts, "")), __holes=_lists(n, pa.array(ids[holes])))

    def text(batches):
        for part in _slices(batches, _body_ends):
            segs, holes, found = (part[c].flatten() for c in ("__segments", "__holes", "__rare"))
            rare_ids, which = np.unique(found.field("__k").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            words = pa.concat_arrays([segs, found.field("__v").cast(pa.string()), pa.array([unknown])])
            ids = holes.to_numpy()
            at = np.searchsorted(rare_ids, ids)
            hit = np.append(rare_ids, UNKNOWN_ID)[at] == ids
            # a row's segments and holes take turns, a segment first and last
            n = _sizes(part["__holes"])
            row = np.arange(part.num_rows)
            order = np.empty(len(segs) + len(ids), np.int64)
            order[2 * np.arange(len(segs)) - np.repeat(row, n + 1)] = np.arange(len(segs))
            order[2 * np.arange(len(ids)) + np.repeat(row, n) + 1] = np.where(hit, len(segs) + np.append(which, 0)[at], len(words) - 1)
            yield _out(part, keys, **{out: pc.binary_join(_lists(2 * n + 1, words.take(pa.array(order))), "")})

    items = rows.mapInArrow(rare, _schema(rows, keys, __k=LongType()))
    body = rows.mapInArrow(segments, _schema(rows, keys, __segments=ArrayType(StringType()), __holes=ArrayType(LongType())))
    return _with_rare(body, items, vocabulary, "id", "piece", keys).mapInArrow(text, _schema(rows, keys, **{out: StringType()}))
