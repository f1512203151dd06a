"""Substring dedup against brute force, and its edge cases."""

import re
from collections import defaultdict

import numpy as np
import pytest

from posttrain.llm import queries, substring_dedup

SF = "/root/testdata/sf0.001"


def _split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def _brute(rows, window):
    """doc_id, text rows (ids may repeat or be null) -> (n_words, n_removed, kept) in order."""
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = _split(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k:k + window])] = min(first[tuple(w[k:k + window])], i)
    out = []
    for i, t in rows:
        w, gone = _split(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, duck):
    import hashlib
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in _brute(rows, 13))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op11_substring_dedup(spark, SF).collect())
    assert got == want and sum(g for _, _, g, _ in got) > 0


@pytest.fixture(scope="module")
def mixed():
    """Few words, so passages meet in many ways; copies, cuts and self-repeats."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(160):
        kind = rng.integers(0, 5)
        if texts and kind < 2:
            a = texts[rng.integers(len(texts))].split(" ")
            b = texts[rng.integers(len(texts))].split(" ")
            t = " ".join([*a[int(rng.integers(0, len(a))):][:40], "new", *b[:int(rng.integers(0, 30))]])
        elif kind == 2:
            t = " ".join(["ab", "c"] * int(rng.integers(5, 40)))
        else:
            t = " ".join(str(x) for x in rng.choice(["é", "b", "cc", "ddd"], rng.integers(0, 60)))
        texts.append(t)
    texts += [None, "", "  \n\t", "x " * 20_000, "x\n" * 15_000, "one\x0btwo three 　 four"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize(("window", "patterns", "segments"), [(13, None, None), (7, 3, 20), (3, 1, 5)])
def test_brute_force_with_small_shards(spark, mixed, monkeypatch, window, patterns, segments):
    if patterns:  # anchors with more passages than a shard takes, shards with many splits
        monkeypatch.setattr(substring_dedup, "PATTERNS", patterns)
        monkeypatch.setattr(substring_dedup, "SHARD", patterns)
        monkeypatch.setattr(substring_dedup, "SEGMENTS", segments)
    df = spark.createDataFrame([(i, t, 1, "k", [2]) for i, t in mixed], "doc_id long, text string, version int, anchor string, ranges array<int>").repartition(6)
    assert _got(substring_dedup.substring_dedup(df, window)) == _brute(mixed, window)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(4, text), (4, text), (4, "a " + text), (None, text), (2, None), (9, text + " end"), (3, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(substring_dedup.substring_dedup(df)) == _brute(rows, 13)


def test_no_rows(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
