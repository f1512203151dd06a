"""Language identification in two levels (operator 4).

Level one picks a language family, level two a language within it; both are
one-versus-one linear support vector machines over hashed byte trigrams and words.
The model is fitted on the driver from a bounded, hash-chosen sample of labelled
rows (at most ``max_per_lang`` a language and ``max_rows`` in all); prediction
reads every whole text in Arrow tasks and moves nothing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, narrow, ship_package

#: Families of related languages; a language that is not listed is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
}
UNKNOWN = "und"
#: Texts whose features are held at once (16 KB each).
SLICE_ROWS = 128
TRIGRAM_BITS, WORD_BITS = 11, 11
DIMS = (1 << TRIGRAM_BITS) + (1 << WORD_BITS)

_SPACE = np.uint8(0x20)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    return next((f for f, langs in families.items() if lang in langs.split()), lang)


def features(part: K.Slice) -> np.ndarray:
    """One row per document: root-scaled counts of hashed trigrams and words of
    letters, at unit length."""
    data = K.lower(part.data)
    data = np.where(_LETTER[data], data, _SPACE)
    n = len(part)
    out = np.zeros((n, DIMS), np.float32)
    if len(data) == 0:
        return out
    doc = np.repeat(np.arange(n), np.diff(part.offsets))
    wide = data.astype(np.uint32)
    gram = wide.copy()
    gram[:-1] |= wide[1:] << 8
    gram[:-2] |= wide[2:] << 16
    slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)
    ends = part.offsets[1:][np.diff(part.offsets) > 0]
    inside = np.ones(len(data), bool)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    size = 1 << TRIGRAM_BITS
    out[:, :size] = np.bincount((doc * size + slot)[inside], minlength=n * size).reshape(n, size)
    w = K._runs(data != _SPACE, part.offsets)
    word = (K.span_hashes(data, w.starts, w.ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    size = 1 << WORD_BITS
    out[:, -size:] = np.bincount(np.repeat(np.arange(n), np.diff(w.first)) * size + word, minlength=n * size).reshape(n, size)
    out = np.sqrt(out)
    for block in (out[:, :-size], out[:, -size:]):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, ridge) by accelerated
    gradient steps; ``y`` is +1 or -1. Both classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    rate = np.float32(1 / (2 * (float((x * x).sum(1).max()) + 1) + reg))
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        nw = vw + rate * (2 * (slack @ x) - reg * vw)
        nb = vb + rate * 2 * slack.sum()
        m = np.float32((t - 1) / (t + 2))
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


class Pairs:
    """One-versus-one machines over some classes."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.classes = sorted(set(label))
        self.machines = []
        for i, j in combinations(range(len(self.classes)), 2):
            rows = (label == self.classes[i]) | (label == self.classes[j])
            y = np.where(label[rows] == self.classes[i], 1, -1).astype(np.float32)
            self.machines.append((i, j, *fit_svm(x[rows], y)))

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each class, from the machines' margins; rows sum to 1."""
        total = np.zeros((len(x), len(self.classes)))
        if not self.machines:
            return total + 1.0
        for i, j, w, b in self.machines:
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w + b), -30, 30)))
            total[:, i] += np.log(p + 1e-6)
            total[:, j] += np.log(1 - p + 1e-6)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, str]):
        family = np.array([family_of(v, families) for v in lang], object)
        self.families = Pairs(x, family)
        self.within = {f: Pairs(x[family == f], lang[family == f]) for f in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shares = self.families.shares(x)
        pick = shares.argmax(axis=1)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families.classes):
            rows = np.flatnonzero(pick == k)
            if len(rows):
                inner = self.within[f].shares(x[rows])
                best = inner.argmax(axis=1)
                lang[rows] = np.array(self.within[f].classes, object)[best]
                score[rows] = shares[rows, k] * inner[np.arange(len(rows)), best]
        return lang, score


def fit(labelled: DataFrame, id_col: str = ID, text_col: str = TEXT, lang_col: str = "lang", max_per_lang: int = 300,
        max_rows: int = 3000, families: dict[str, str] | None = None) -> Model | None:
    """Model from rows with a language; None if there are none. Languages beyond
    ``max_rows / 2`` keep the most frequent ones."""
    rows = narrow(labelled, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_rows // 2).collect()}
    if not counts:
        return None
    per = max(2, min(max_per_lang, max_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per / n))])
    pick = F.pmod(F.xxhash64(F.lit(4), F.col(ID)), F.lit(1 << 30)) / (1 << 30)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batch.column(1), rows=SLICE_ROWS):
            x = features(part)
            rows_ = batch.column(2).slice(part.first, len(part))
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays(
                [rows_, pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * DIMS), flat)], names=["lang", "x"])

    got = arrow_map(rows.where(pick < share[F.col("lang")]), run, "lang string, x array<float>").toPandas()
    if got.empty:
        return None
    return Model(np.stack(got["x"].to_numpy()).astype(np.float32), got["lang"].to_numpy(object), families or FAMILIES)


def _told(texts: pa.Array, model: Model | None) -> Iterator[tuple[K.Slice, np.ndarray, np.ndarray]]:
    """Language and score of each text, slice by slice."""
    for part in K.slices(texts, rows=SLICE_ROWS):
        lettered = np.array([has_letter(t) for t in texts.slice(part.first, len(part)).to_pylist()], bool)
        lang, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
        if model is not None and lettered.any():
            lang[lettered], score[lettered] = model.predict(features(part)[lettered])
        yield part, lang, score


def predict(docs: DataFrame, model: Model | None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, lang_pred, score`` per input row. ``und`` with score 0 for a text
    that is null or has no letter, and for every text without a model. Repeated
    rows get equal results; an empty table gives none; other columns are ignored."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, lang, score in _told(batch.column(1), model):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(lang, pa.string()), pa.array(score)],
                                             names=[ID, "lang_pred", "score"])

    return arrow_map(narrow(docs, id_col, text_col), run, f"{ID} long, lang_pred string, score double")


def tagged(docs: DataFrame, model: Model | None, text_col: str = TEXT) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` as in ``predict`` (columns of
    these names are replaced), in one pass and without a join."""
    ship_package(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, lang, score in _told(batch.column(at), model):
            own = [c.slice(part.first, len(part)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    more = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow_map(rows, run, StructType([*rows.schema.fields, *more.fields]))
