"""Vectorised text kernels used inside Arrow tasks.

Everything works on the UTF-8 bytes of a slice of documents at once, so the
cost per word is a few array operations instead of a Python call. A slice
holds whole documents only (at least one, about ``SLICE_BYTES`` otherwise)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U64 = np.uint64
# The finaliser constants of the public splitmix64 generator.
MIX_A, MIX_B, MIX_GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASE = U64(0x5851F42D4C957F2D)  # odd, so its powers have inverses modulo 2^64
_BASE_INV = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: ASCII white space: space and 0x09-0x0D.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps = np.full(size, _BASE_INV, np.uint64)
        steps[0] = 1
        _inverse_powers = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse_powers


class Slice:
    """Some whole documents: their bytes ``data`` and the boundaries ``offsets``
    (one more than documents). A null text counts as empty. ``first`` is the row
    of the first document in its batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[Slice]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = end if rows is None else min(end, at + rows)
        yield Slice(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at], at)
        at = end


class Spans:
    """Pieces of a slice: byte ``starts`` and ``ends`` and, per document, the
    range ``first[d]:first[d + 1]`` of its pieces."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.first = starts, ends, first


def _runs(inside: np.ndarray, bounds: np.ndarray) -> Spans:
    """Maximal runs of True that do not cross a boundary."""
    n = len(inside)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Spans(zero, zero, np.zeros(len(bounds), np.int64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = bounds[1:-1][bounds[1:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Spans(starts, ends, np.searchsorted(starts, bounds))


def words(part: Slice, bounds: np.ndarray | None = None) -> Spans:
    """Words ``[^\\x20\\x09-\\x0D]+`` within the bounds (documents by default)."""
    return _runs(~_IS_SPACE[part.data], part.offsets if bounds is None else bounds)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte codes, read
    off one running sum, then mixed with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers[:len(data)], dtype=np.uint64, out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * MIX_GOLDEN)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles, and the range of each document in
    them. A document of fewer words gives its whole sequence as one shingle; one
    without words gives none."""
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(count, out=out_first[1:])
    doc = np.repeat(np.arange(len(n_words)), count)
    at = first[:-1][doc] + (np.arange(out_first[-1]) - out_first[:-1][doc])
    size = np.minimum(n_words[doc], width)
    total = size.astype(np.uint64)
    padded = np.concatenate([word_hash, np.zeros(width, np.uint64)])
    for j in range(width):
        total = np.where(j < size, mix64(total * MIX_GOLDEN + padded[at + j]), total)
    return total, out_first


def distinct_per_group(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group, and the new group ranges."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    out = np.zeros(len(first), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: its first row, the sorted distinct shingle hashes of its
    documents and the range of each document."""
    for part in slices(texts):
        w = words(part)
        hashes = span_hashes(lower(part.data), w.starts, w.ends)
        values, first = distinct_per_group(*shingles(hashes, w.first, width))
        yield part.first, values, first


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two-word key of each set ``values[first[i]:first[i + 1]]``, whatever its
    order: independent sums of mixed elements."""
    key = np.zeros((len(first) - 1, 2), np.uint64)
    # Two odd 64-bit salts.
    for c, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix64(values + np.uint64(salt)), dtype=np.uint64, out=total[1:])
        key[:, c] = mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    return key


def key_array(key: np.ndarray) -> pa.Array:
    """The keys as 16-byte binary values."""
    raw = np.ascontiguousarray(key)
    return pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and group ranges."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))
