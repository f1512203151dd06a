"""Toxicity by weak supervision (operator 3).

1. A lexicon is learned from a bounded sample of labelled rows (document counts
   per word and label, summed by Spark). Every word that passes the tests is in it:
   the first ``SINGLE_WORDS`` and the seed words have a count each, all others share
   ``WORD_BINS`` counts by hash.
2. Voters read every whole text: each lexicon group fires or abstains; pattern
   voters look at the number, the share and the variety of lexicon words, at
   shouting and at exclamation.
3. A generative label model is fitted to the counts of vote patterns over all
   documents: expectation-maximisation gives each voter's rates per class; pairs
   of voters that stay correlated within the classes get a joint table. Patterns
   are at most ``2^(groups + patterns)``, whatever the number of rows.
4. A linear classifier is trained on the posterior labels of a bounded sample and
   scores every document."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from posttrain.llm import kernels as K
from posttrain.llm.common import ID, TEXT, arrow_map, bounded_sample, log_odds_fit, narrow, stored

MAX_LABELLED, MAX_TRAIN, GROUPS = 20_000, 20_000, 8
SINGLE_WORDS, WORD_BINS = 40, 16
#: Words every lexicon starts with; learned words come on top.
SEED_WORDS = "idiot moron stupid scum loser pathetic worthless disgusting trash bastard bitch retard dumb filthy".split()
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_LETTERS = r"[\x00-\x60\x7b-\x7f]+"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
PATTERNS = ("several_words", "dense", "varied", "shouting", "exclaiming")


class Lexicon:
    """``single`` words have a column each; ``binned`` ones share ``WORD_BINS`` columns
    behind them."""

    def __init__(self, single: list[str], binned: list[str] = ()):
        raw = [w.encode() for w in (*single, *binned)]
        ends = np.cumsum([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = K.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        column = np.arange(len(raw))
        column[len(single):] = len(single) + (hashes[len(single):] % np.uint64(WORD_BINS)).astype(np.int64)
        self.words, self.sorted, self.column = [*single, *binned], hashes[order], column[order]
        self.width = len(single) + (WORD_BINS if binned else 0)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Seed words and all words whose document counts differ between the labels (z of
    the smoothed log odds), from ``doc_id, text, y`` rows. Their number is bounded by
    the sample: each stands in five of its positive rows at least."""
    rows = bounded_sample(labelled, ID, MAX_LABELLED, 3)
    words = (rows.select("y", F.explode(F.array_distinct(F.split(F.translate(F.coalesce(TEXT, F.lit("")), _A_Z, _a_z), _NOT_LETTERS))).alias("word"))
             .where("word <> ''").groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    total = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0)).alias("neg")).first()
    odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = (words.where("pos >= 5").withColumn("odds", odds).withColumn("z", z).where("z >= 4 AND odds >= 1.5")
            .orderBy(F.desc("z"), "word").select("word").collect())
    learned = [r["word"] for r in best]
    single = list(dict.fromkeys(learned[:SINGLE_WORDS] + SEED_WORDS))
    return Lexicon(single, [w for w in learned[SINGLE_WORDS:] if w not in SEED_WORDS])


def measures(part: K.Slice, lexicon: Lexicon) -> np.ndarray:
    """Per document: counts of the lexicon's columns, then the number of words, the
    share of upper-case bytes and the share of exclamation marks."""
    n, size = len(part), np.diff(part.offsets)
    width = lexicon.width
    out = np.zeros((n, width + 3))
    if len(part.data) == 0:
        return out
    data = K.lower(part.data)
    w = K._runs(_LETTER[data], part.offsets)
    of = np.repeat(np.arange(n), np.diff(w.first))
    hashes = K.span_hashes(data, w.starts, w.ends)
    at = np.minimum(np.searchsorted(lexicon.sorted, hashes), len(lexicon.sorted) - 1)
    hit = lexicon.sorted[at] == hashes
    out[:, :width] = np.bincount(of[hit] * width + lexicon.column[at[hit]], minlength=n * width).reshape(n, width)
    out[:, width] = np.diff(w.first)
    doc = np.repeat(np.arange(n), size)
    out[:, width + 1] = np.bincount(doc, _UPPER[part.data], n) / np.maximum(size, 1)
    out[:, width + 2] = np.bincount(doc, part.data == 33, n) / np.maximum(size, 1)
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """One column per voter, 1 where it fires: lexicon groups (columns dealt round by
    rank), then ``PATTERNS``."""
    width = m.shape[1] - 3
    counts, words = m[:, :width], m[:, width]
    groups = [counts[:, g::GROUPS].sum(1) > 0 for g in range(GROUPS)]
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    return np.stack([*groups, total >= 2, total >= words / 150 + 0.5, kinds >= 2, m[:, width + 1] > 0.3, m[:, width + 2] > 0.01], 1).astype(np.int64)


def inputs(m: np.ndarray) -> np.ndarray:
    """Inputs of the linear classifier."""
    width = m.shape[1] - 3
    counts, words = m[:, :width], m[:, width]
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    return np.column_stack([np.log1p(counts), np.log1p(total), np.log1p(kinds), 100 * total / np.maximum(words, 50),
                            total > 0, np.log1p(words) / 10, m[:, width + 1:]])


class LabelModel:
    """P(votes | class) as a product over single voters and correlated pairs."""

    def __init__(self, v: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 40):
        """``v``: vote patterns; ``count``: their documents; ``label``: 0, 1 or
        nan where it is not known."""
        self.factors: list[tuple[int, ...]] = [(i,) for i in range(v.shape[1])]
        known = ~np.isnan(label)
        rate = np.average(label[known], weights=count[known]) if known.any() else 0.1
        self.prior = float(np.clip(rate, 0.01, 0.99))
        post = np.where(known, np.nan_to_num(label), np.clip(self.prior * (0.2 + v[:, :GROUPS].sum(1) * 2), 0.001, 0.95))
        post = self._run(v, count, label, known, post, rounds)
        self.correlation = self._correlations(v, count, post)
        free = set(range(v.shape[1]))
        for c, i, j in sorted(((abs(self.correlation[i, j]), i, j) for i, j in combinations(range(v.shape[1]), 2)), reverse=True):
            if c >= 0.15 and i in free and j in free:
                free -= {i, j}
                self.factors = [f for f in self.factors if f not in ((i,), (j,))] + [(i, j)]
        self._run(v, count, label, known, post, rounds)

    @staticmethod
    def _cell(v: np.ndarray, f: tuple[int, ...]) -> np.ndarray:
        return v[:, f[0]] if len(f) == 1 else 2 * v[:, f[0]] + v[:, f[1]]

    @staticmethod
    def _correlations(v: np.ndarray, count: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Mean within-class correlation of each pair of voters."""
        out = np.zeros((v.shape[1], v.shape[1]))
        for p in (post, 1 - post):
            w = count * p
            x = v - np.average(v, axis=0, weights=w + 1e-12)
            cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out += cov / sd[:, None] / sd * (w.sum() / max(count.sum(), 1e-9))
        return out

    def _run(self, v, count, label, known, post, rounds) -> np.ndarray:
        for _ in range(rounds):
            self.tables = []
            for f in self.factors:
                cell = self._cell(v, f)
                size = 2 ** len(f)
                t = np.stack([np.bincount(cell, count * (1 - post), size), np.bincount(cell, count * post, size)]) + 0.5
                self.tables.append(np.log(t / t.sum(axis=1, keepdims=True)))
            self.prior = float(np.clip(np.average(post, weights=count), 0.01, 0.99))
            new = np.where(known, np.nan_to_num(label), self.posterior(v))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return post

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for f, t in zip(self.factors, self.tables, strict=True):
            odds += (t[1] - t[0])[self._cell(v, f)]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _measured(docs: DataFrame, lexicon: Lexicon, *extra: str) -> DataFrame:
    """``doc_id, m array<double>`` and the extra columns, per input row."""
    width = lexicon.width + 3
    schema = docs.select(ID, *extra).schema.add("m", ArrayType(DoubleType()))
    text_at = docs.columns.index(TEXT)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = [i for i in range(batch.num_columns) if i != text_at]
        for part in K.slices(batch.column(text_at)):
            rows = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(part.first, len(part)) for i in keep),
                 pa.ListArray.from_arrays(rows, pa.array(measures(part, lexicon).ravel()))], names=[f.name for f in schema])

    return arrow_map(docs.select(ID, TEXT, *extra), run, schema)


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, label_model: LabelModel):
        self.lexicon, self.weights, self.label_model = lexicon, weights, label_model

    def score(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(m) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT,
                  label_col: str = "toxic") -> tuple[DataFrame, Model | None]:
    """``doc_id, score`` in [0, 1] per row of ``docs``, learned from ``labels``
    (``doc_id`` and ``label_col``, 0 or 1; null labels are left out), and the model.
    Null and empty texts have no votes and get the score of such a text; without a
    row in ``docs`` there are no rows and no model; without labels the seed lexicon
    and the label model work alone. Repeated rows get equal scores."""
    rows = narrow(docs, id_col, text_col)
    known = (labels.select(F.col(ID).cast("long").alias(ID), F.col(label_col).cast("double").alias("y"))
             .where("y IS NOT NULL").groupBy(ID).agg(F.max("y").alias("y")))
    picked = bounded_sample(known, ID, MAX_LABELLED, 3)
    lexicon = learn_lexicon(rows.join(picked, ID).select(ID, TEXT, "y"))
    width = lexicon.width + 3
    measured = stored(_measured(rows, lexicon), "toxicity_measures")

    def patterns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = votes(_stack(batch.column(0), width))
        code = v @ (1 << np.arange(v.shape[1]))
        y = batch.column(1).fill_null(-1.0).to_numpy(zero_copy_only=False)
        key, n = np.unique(np.stack([code, y.astype(np.int64)]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(n)], names=["code", "y", "n"])

    seen = (arrow_map(measured.join(known, ID, "left").select("m", "y"), patterns, "code long, y long, n long")
            .groupBy("code", "y").agg(F.sum("n").alias("n")).toPandas())
    if seen.empty:
        return measured.select(ID, F.lit(0.0).alias("score")), None
    v = (seen["code"].to_numpy()[:, None] >> np.arange(GROUPS + len(PATTERNS))) & 1
    label = np.where(seen["y"] < 0, np.nan, seen["y"]).astype(float)
    label_model = LabelModel(v, seen["n"].to_numpy(float), label)

    got = bounded_sample(measured, ID, MAX_TRAIN, 33).select("m").toPandas()
    m = np.stack(got["m"].to_numpy())
    model = Model(lexicon, log_odds_fit(inputs(m), label_model.posterior(votes(m))), label_model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stack(batch.column(1), width)))], names=[ID, "score"])

    return arrow_map(measured.select(ID, "m"), run, f"{ID} long, score double"), model
