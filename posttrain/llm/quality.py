"""Quality classifier (operator 9): random Fourier features over document
statistics, ridge scores from partition-summed normal equations, isotonic
calibration.

One scan turns each whole text into ``STATS`` numbers; only these are joined with
the labels. Every task adds its rows into one matrix of fixed size; the cells are
summed by Spark (partial sums before the shuffle). Calibration counts scores in a
fixed number of bins. The driver sees sums only, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, narrow, stored

STATS = ("log_bytes", "lower", "upper", "digit", "space", "stop", "mark", "symbol", "high_byte", "bang", "bar",
         "log_words", "word_length", "word_distinct", "word_top", "word_repeat", "word_symbol", "word_upper",
         "log_lines", "line_length", "line_distinct")
RFF_DIMS, BINS, SEED = 160, 400, 9

_CLASS = np.full(256, 7, np.int64)  # symbol
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3),
                   (" \t\r\v\f\n", 4), (".?", 5), (",;:'\"()-", 6), ("!", 9), ("|", 10)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 8


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(part: K.Slice) -> np.ndarray:
    """``len(part) x len(STATS)``; zeros for an empty text."""
    n = len(part)
    size = np.diff(part.offsets)
    out = np.zeros((n, len(STATS)))
    if len(part.data) == 0:
        return out
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[part.data]
    count = np.bincount(doc * 11 + kind, minlength=n * 11).reshape(n, 11)
    out[:, 0] = np.log1p(size)
    out[:, 1:11] = count[:, 1:11] / np.maximum(size, 1)[:, None]
    w = K.words(part)
    n_words = np.diff(w.first)
    of = np.repeat(np.arange(n), n_words)
    hashes = K.span_hashes(K.lower(part.data), w.starts, w.ends)
    out[:, 11] = np.log1p(n_words)
    out[:, 12] = _share(np.bincount(of, w.ends - w.starts, n), n_words)
    for d in range(n):
        if n_words[d]:
            c = np.unique(hashes[w.first[d]:w.first[d + 1]], return_counts=True)[1]
            out[d, 13], out[d, 14] = len(c) / n_words[d], c.max() / n_words[d]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out[:, 15] = _share(np.bincount(of, same, n), n_words)
    for column, flag in ((16, (kind == 7) | (kind == 10)), (17, kind == 2)):
        run = np.concatenate([[0], np.cumsum(flag)])
        hits = run[w.ends] - run[w.starts]
        out[:, column] = _share(np.bincount(of, hits > (0 if column == 16 else 1), n), n_words)
    lines = K._runs(part.data != 0x0A, part.offsets)
    n_lines = np.diff(lines.first)
    line_hash = K.span_hashes(part.data, lines.starts, lines.ends)
    out[:, 18] = np.log1p(n_lines)
    out[:, 19] = np.log1p(_share(np.bincount(np.repeat(np.arange(n), n_lines), lines.ends - lines.starts, n), n_lines))
    for d in range(n):
        if n_lines[d]:
            out[d, 20] = len(np.unique(line_hash[lines.first[d]:lines.first[d + 1]])) / n_lines[d]
    return out


def document_statistics(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id, x array<double>`` per input row; null counts as empty."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batch.column(1)):
            x = statistics(part)
            rows = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)),
                                              pa.ListArray.from_arrays(rows, pa.array(x.ravel()))], names=[ID, "x"])
    return arrow_map(narrow(docs, id_col, text_col), run, f"{ID} long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


class Model:
    """Scaling, random Fourier map, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, dims: int = RFF_DIMS):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.maximum(std, 1e-6)
        width = np.sqrt(len(STATS)) * 0.8  # of the Gaussian kernel, in scaled units
        self.w, self.b = rng.normal(0, 1 / width, (len(STATS), dims)), rng.uniform(0, 2 * np.pi, dims)
        self.beta, self.knots = np.zeros(dims + 1), None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        f = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []  # sum, weight, length
    for v, w in zip(value, weight, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w_, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w_
            blocks[-1][2] += n
    return np.concatenate([np.full(n, s / w) for s, w, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", ridge: float = 1e-3) -> Model | None:
    """Model from ``doc_id, x`` rows and ``doc_id, label`` rows (0 or 1; null labels
    are left out); None without labelled rows or with one class only."""
    known = labels.select(F.col(ID).cast("long").alias(ID), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    train = stored(stats.join(known, ID).select("x", "y"), "quality_train")
    cells = [f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(F.count("*").alias("n"), F.avg("y").alias("rate"), *cells).first()
    if not row["n"] or row["rate"] in (0.0, 1.0):
        return None
    model = Model(np.array([row[f"m{i}"] for i in range(len(STATS))]), np.array([row[f"s{i}"] for i in range(len(STATS))]))
    weight = (0.5 / (1 - row["rate"]), 0.5 / row["rate"])  # the classes weigh alike in the ridge fit
    dims = RFF_DIMS + 1
    upper = np.triu_indices(dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((dims, dims)), np.zeros(dims)
        for batch in batches:
            z = model.map(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy()
            m = np.where(y > 0.5, weight[1], weight[0])
            a += (z * m[:, None]).T @ z
            b += z.T @ (m * y)
        value = np.concatenate([a[upper], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["cell", "value"])

    got = train.mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    value = got.sort_values("cell")["value"].to_numpy()
    a = np.zeros((dims, dims))
    a[upper] = value[:-dims]
    a = a + a.T - np.diag(np.diag(a))
    penalty = np.full(dims, ridge * row["n"])
    penalty[-1] = 0
    model.beta = np.linalg.solve(a + np.diag(penalty), value[-dims:])

    def bins(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = model.raw(_matrix(batch.column(0)))
        at, y = _bin(raw), batch.column(1).to_numpy()
        used = np.unique(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(np.bincount(at, v, BINS)[used]) for v in (y, raw, np.ones(len(y))))],
            names=["bin", "y", "raw", "n"])

    hist = (arrow_map(train, bins, "bin int, y double, raw double, n double")
            .groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("y", "raw", "n"))).toPandas().sort_values("bin"))
    n = hist["n"].to_numpy()
    level = isotonic(hist["y"].to_numpy() / n, n)
    model.knots = (np.maximum.accumulate(hist["raw"].to_numpy() / n), level)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` in [0, 1], higher for likelier label 1; 0.5 without a model."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model is not None else np.full(len(x), 0.5))],
                                         names=[ID, "score"])
    return arrow_map(stats.select(ID, "x"), run, f"{ID} long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT, label_col: str = "quality") -> DataFrame:
    """Fit on ``labels`` (``doc_id`` and ``label_col``) and score every row of
    ``docs``: ``doc_id, score``. Null and empty texts are scored as texts without
    words; repeated rows get equal scores; an empty table gives no rows."""
    stats = stored(document_statistics(docs, id_col, text_col), "quality_stats")
    return score(stats, fit(stats, labels, label_col))
