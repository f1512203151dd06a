"""Byte-level BPE encoding and decoding (operator 8).

Encoding: a text is cut before every space that a non-space follows; no match of
the split pattern runs over such a place, so a unit between two cuts is encoded
alike alone and in its text. The tokenizers library encodes the units (split
pattern, byte-to-character mapping, merges) and gives each token's character
offsets. Units repeat heavily, so a task keeps the encodings of the units it has
met (at most about ``CACHE_UNITS``, then it starts anew) and hands only new ones
to the library, a batch at a time. A text in which white space follows a space is
cut at the pattern's own matches instead. Decoding reverses the byte table of
the vocabulary: ids become bytes; characters split over tokens come together
again because bytes are joined before they are read as text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm.common import ID, TEXT, arrow_map, give_back, narrow

CACHE_UNITS = 250_000
#: Bytes of the texts that are handled together (a longer text: alone).
GROUP_BYTES = 1 << 20
_ODD_SPACE = re.compile(r" (?:\s|\Z)").search


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def byte_characters() -> dict[str, int]:
    """The byte-to-character table of byte-level BPE, reversed: printable bytes
    stand for themselves, the others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: type):
        self._room, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self._room):
            room = np.empty(max(end, 2 * len(self._room)), self._room.dtype)
            room[:self.size] = self._room[:self.size]
            self._room = room
        self._room[self.size:end] = values
        self.size = end

    @property
    def array(self) -> np.ndarray:
        return self._room[:self.size]


class Codec:
    """One per task: the library's tokenizer and the pieces met so far."""

    _open: dict[tuple[str, bool], "Codec"] = {}

    @classmethod
    def at(cls, path: str, offsets: bool = True) -> "Codec":
        if (path, offsets) not in cls._open:
            cls._open[path, offsets] = cls(path, offsets)
        return cls._open[path, offsets]

    def __init__(self, path: str, offsets: bool):
        import regex
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.offsets = offsets
        self.batch = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.pieces = regex.compile(split_pattern()).findall
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        table = byte_characters()
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.known: dict[str, int] = {}  # by unit, without the space before it
        self.exact: dict[str, int] = {}  # by unit as it is
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.exact.clear()
        self.count, self.first, self.ids, self.ends = (_Grown(k) for k in (np.int64, np.int64, np.int32, np.int32))

    def _codes(self, units: list[str], known: dict[str, int], before: str) -> np.ndarray:
        new = list(set(units).difference(known))
        if new:
            met = self.batch([before + u for u in new] if before else new, add_special_tokens=False)
            ids = [e.ids for e in met]
            known.update(zip(new, range(self.count.size, self.count.size + len(new)), strict=True))
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first.add(self.ids.size + np.cumsum(count) - count)
            self.count.add(count)
            self.ids.add(np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum())))
            if self.offsets:
                self.ends.add(np.fromiter((b for e in met for _, b in e.offsets), np.int32, int(count.sum())))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Flat ids of all texts, the ids of each text, and each token's end as a
        character position in its text."""
        if self.count.size > CACHE_UNITS:
            self._reset()
        n, spaced, plain, is_plain = [], [], [], []
        for t in texts:
            if _ODD_SPACE(t):
                units = self.pieces(t)
                plain += units
                is_plain.append(np.ones(len(units), bool))
            else:
                units = t.split(" ")
                plain.append(units[0])
                spaced += units[1:]
                flags = np.zeros(len(units), bool)
                flags[0] = True
                is_plain.append(flags)
            n.append(len(units))
        where = np.concatenate(is_plain) if is_plain else np.zeros(0, bool)
        code, size = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
        code[where] = self._codes(plain, self.exact, "")
        code[~where] = self._codes(spaced, self.known, " ")
        count, first, ids, ends = (x.array for x in (self.count, self.first, self.ids, self.ends))
        per = count[code]
        total = np.concatenate([[0], np.cumsum(per)])
        at = np.repeat(first[code] - total[:-1], per) + np.arange(total[-1])
        doc_first = total[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        if not self.offsets:
            return ids[at], doc_first, None
        size[where] = np.fromiter(map(len, plain), np.int64, len(plain))
        size[~where] = np.fromiter(map(len, spaced), np.int64, len(spaced)) + 1
        text_start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
        start = np.cumsum(size) - size - np.repeat(text_start, n)
        return ids[at], doc_first, (np.repeat(start, per) + ends[at]).astype(np.int32)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes and the bytes of each document."""
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.starts[ids] - total[:-1], size) + np.arange(total[-1])
        return self.all_bytes[at], total[first]


def _groups(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``GROUP_BYTES``."""
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + GROUP_BYTES, "right")) - 1)
        yield a, b
        a = b


def _encoded(batch: pa.RecordBatch, codec: "Codec") -> Iterator[pa.RecordBatch]:
    """Id and text to id, token ids and, with offsets, token ends."""
    texts = batch.column(1).fill_null("")
    for a, b in _groups(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)):
        ids, first, ends = codec.encode(texts.slice(a, b - a).to_pylist())
        rows = pa.array(first.astype(np.int32))
        cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(rows, pa.array(ids))]
        names = [ID, "ids"]
        if codec.offsets:
            cols.append(pa.ListArray.from_arrays(rows, pa.array(ends)))
            names.append("token_ends")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _decoded(batch: pa.RecordBatch, codec: "Codec", at: int) -> Iterator[pa.RecordBatch]:
    """The batch with the bytes of the ids in column ``at``."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    for a, b in _groups(lengths.astype(np.int64) * 4):
        part = batch.slice(a, b - a)
        lists = part.column(at).fill_null([])
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, bounds = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first)
        out = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, offsets: bool = False,
           path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` (and ``token_ends array<int>``, character
    positions, with ``offsets``) per input row, in no special order. A null or
    empty text gives an empty list; repeated rows each give a row; an empty table
    gives none; strings of special tokens are ordinary text. ``path`` is the
    vocabulary file, at the same place on every machine."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batch, Codec.at(path, offsets))

    return arrow_map(narrow(docs, id_col, text_col), run,
                     f"{ID} long, ids array<int>" + (", token_ends array<int>" if offsets else ""))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The input with ``decoded binary``: the bytes of the ids. A null list gives
    no bytes. An id outside the vocabulary fails the job."""
    path = path or vocabulary_path()
    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    names = [f.name for f in schema.fields[:-1]]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _decoded(batch, Codec.at(path, False), names.index(ids_col))

    return arrow_map(encoded.select(*names), run, schema)


def encode_and_decode(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` as ``decode(encode(docs))``, in one Python worker a task.
    The pieces that a task has met are dropped at its end, for jobs that go on to
    other work on the same executors."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path, False)
        for batch in batches:
            for part in _encoded(batch, codec):
                yield from _decoded(part, codec, 1)
        codec._reset()
        give_back()

    return narrow(docs, id_col, text_col).mapInArrow(run, f"{ID} long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    return decoded.select(
        ID, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
