"""Operators over whole tables against brute force, and their edge cases."""

import hashlib
import re
from collections import defaultdict
from datetime import date
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posttrain.llm import components, decontaminate, exact_dedup, kernels, line_dedup, minhash, queries, url_lists

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, key string, n double, lines array<int>, version string"


def _words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]


def _texts(rng, n):
    """Random texts with exact copies, near copies, shared passages and shared lines."""
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.integers(0, 4)
        if texts and kind == 0:
            t = texts[rng.integers(len(texts))]
        elif texts and kind == 1:
            t = texts[rng.integers(len(texts))].split(" ")
            for _ in range(int(rng.integers(1, 4))):
                t[rng.integers(len(t))] = str(rng.choice(vocab))
            t = " ".join(t)
        else:
            t = " ".join(("\n" if rng.random() < 0.1 else "") + str(w) for w in rng.choice(vocab, rng.integers(1, 60)))
        texts.append(t)
    return texts


@pytest.fixture(scope="module")
def corpus(spark):
    texts = _texts(np.random.default_rng(8), 250) + [None, "", " \n ", "One", "one", "A b", "a B\n", "x " * 30_000]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame([(i, t, "k", 0.5, [1], "v") for i, t in rows], CLASH).repartition(7)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


# --- operator 1

def _components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = _words(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, _components(list(sets), links)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_brute_force(corpus, width):
    rows, df = corpus
    size, component = _near(rows, width, 80)
    got = minhash.near_duplicates(df, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (size[i], component[i]) for i, _ in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_query(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    size, component = _near(rows, 2, 80)
    got = queries.op1_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (size[i], component[i]) for i, _ in rows}


def test_near_duplicates_edges(spark, nothing):
    assert minhash.near_duplicates(nothing).collect() == []
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (9, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_shingles"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, 0, True), (-1, 3, 1, False), (3, 3, 1, True), (3, 3, 1, True), (9, 9, 0, True)]


def test_near_duplicates_of_null_and_shared_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    other, third = " ".join(["x", *words[1:]]), " ".join([*words[:-1], "y"])
    df = spark.createDataFrame([(7, text), (None, other), (7, third), (None, "p q r s"), (None, "p q r t")], "doc_id long, text string")
    got = minhash.near_duplicates(df, width=2).collect()
    assert [r["component_id"] for r in got if r["n_shingles"] > 10] == [7, 7, 7]
    # one row of the group stays, the same under any order of rows
    kept = [r for r in got if r["n_shingles"] > 10 and r["kept"]]
    assert len(kept) == 1 and kept[0]["version"] == min(r["version"] for r in got if r["doc_id"] == 7)
    assert [r["kept"] for r in got if r["n_shingles"] < 10] == [True, True]
    nameless = spark.createDataFrame([(None, text), (None, other)], "doc_id long, text string")
    assert sorted(r["kept"] for r in minhash.near_duplicates(nameless, width=2).collect()) == [False, True]


def test_super_min_hash_estimates_jaccard():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400):
        error = []
        for _ in range(40):
            pool = rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
            shared = int(n * 0.7)
            x, y = pool[:n], np.concatenate([pool[:shared], pool[n:2 * n - shared]])
            sig = minhash.super_min_hash(np.concatenate([x, y]), np.array([0, n, 2 * n]))
            error.append((sig[0] == sig[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def test_components_chains_and_stars(spark):
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (None, 5)]
    links += [tuple(x) for x in rng.integers(300, 360, (50, 2)).tolist()]
    df = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = _components(sorted({x for p in real for x in p}), real)
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == want
    assert components.components(df.where("false")).collect() == []


# --- operator 2

ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards quietly watch the river bend"),
         (2, "Ça été une journée très ensoleillée, pourtant personne n'est venu au marché de la vieille ville"),
         (3, None), (4, "short"), (5, "")]


def test_decontamination_finds_exact_and_edited_items(spark):
    one, two = ITEMS[0][1], ITEMS[1][1]
    fill = " ".join(f"filler{i}" for i in range(80))
    docs = [(1, f"{fill} {one} {fill}"), (2, f"{fill}\n{one.upper().replace(' ', '  ')}"), (3, one.replace("brown", "red").replace("seven", "nine")),
            (4, f"é{two}"), (5, fill), (6, None), (7, ""), (8, one[:40] + fill), (9, f"{one} {two}"), (9, f"{one} {two}"), (None, two)]
    got = decontaminate.leaks(spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, version string"),
                              spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 2), (1, 1), (2, 1), (3, 1), (4, 2), (9, 1), (9, 1), (9, 2), (9, 2)]
    at = {(r["doc_id"], r["item_id"]): r for r in got}
    assert docs[0][1][at[1, 1]["start"]:at[1, 1]["end"]] == one and at[1, 1]["distance"] == 0
    assert docs[3][1][at[4, 2]["start"]:at[4, 2]["end"]] == two


def test_alignment_is_the_edit_distance():
    rng = np.random.default_rng(3)

    def plain(item, text):
        best = row = list(range(len(item) + 1))
        low = row[-1]
        for c in text:
            new = [0]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            low = min(low, row[-1])
        return low

    for _ in range(200):
        item, text = ("".join(rng.choice(list("abc"), rng.integers(1, n))) for n in (20, 40))
        found = decontaminate.align(item, text, len(item))
        assert found is not None and found[0] == plain(item, text)
        assert decontaminate.may_align(item, text, found[0])


def test_decontamination_recall_of_random_edits():
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, 40))) for i in range(150)]
    items = decontaminate.Items(rows)
    texts = []
    for _, t in rows:
        words = t.split(" ")
        for k in rng.choice(40, 5, replace=False):
            words[k] = str(rng.choice(vocab))
        texts.append(" ".join(rng.choice(vocab, 30)) + " " + " ".join(words) + " " + " ".join(rng.choice(vocab, 30)))
    true = {i for i, (_, t) in enumerate(rows) if decontaminate.align(t, texts[i], int(0.2 * len(t)))}
    found = {r for r, i, *_ in decontaminate._matches(pa.array(texts), items, 0.2) if r == i}
    assert len(true) > 100 and len(found & true) >= 0.97 * len(true)


@pytest.mark.parametrize("max_edit", [0.05, 0.2, 0.35])
def test_decontamination_equals_brute_force(max_edit):
    """Edits spread over the characters, scripts without spaces, items of a few characters."""
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 30))) for _ in range(12)]
    texts += ["".join(rng.choice(list("春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"), n)) for n in (1, 4, 5, 11, 30, 90)]
    texts += ["".join(rng.choice(list("abcdefgh"), n)) for n in range(1, 13)] + ["x" * 200]
    items = decontaminate.Items(list(enumerate(texts)))
    docs = ["", None]
    for t in texts:
        for share in (0, 0.1, 0.16, 0.2):
            x = list(t)
            for _ in range(int(share * len(t))):
                k = rng.integers(0, len(x))
                x[k:k + 1] = [["q"], [], ["q", x[k]]][rng.integers(0, 3)]
            docs.append(f"{texts[rng.integers(12)][:40]}{''.join(x)}{texts[rng.integers(12)][:40]}")
        # one changed character at the end of each word
        docs.append(" ".join(w[:-1] + "q" for w in t.split(" ")))
    want = {}
    for r, d in enumerate(docs):
        for i, t in enumerate(texts):
            found = decontaminate.align(t, decontaminate.normal(d or ""), int(max_edit * len(t)))
            if found:
                want[r, i] = found[0]
    assert {(r, i): d for r, i, d, *_ in decontaminate._matches(pa.array(docs), items, max_edit)} == want


def test_decontamination_edges(spark, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(nothing, items).collect() == []
    docs = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    assert decontaminate.leaks(docs, items.where("false")).collect() == []
    assert decontaminate.decontaminate(docs, items).collect() == [] and decontaminate.decontaminate(docs, items.where("false")).count() == 1


def test_decontamination_query(spark, duck):
    """Every document that holds an item word for word is found."""
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, SF).collect()}
    assert want <= got and want


# --- operator 5

def test_exact_dedup_edges(spark, nothing):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a"), (5, "a"), (None, "a"), (7, "x" * 200 + "1"), (8, "x" * 200 + "2"), (9, "é"), (10, "ab")]
    got = exact_dedup.exact_dedup(spark.createDataFrame([(i, t, "k", 1, "h") for i, t in rows], "doc_id long, text string, len string, bit int, head string")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in got) == [
        (-1, 5, 4, False), (1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (4, 4, 1, True), (5, 5, 4, True), (5, 5, 4, True),
        (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)]
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_exact_dedup_query_keeps_rows_of_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, "a"), (1, "a"), (1, "b"), (1, "b"), (2, None), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    got = queries.op5_exact_dedup(spark, "").collect()
    digest = {t: hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert sorted((r["doc_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted([
        (-1, 2, False, digest["a"]), (1, 2, True, digest["a"]), (1, 2, True, digest["b"]), (1, 2, True, digest["b"]),
        (2, 1, True, digest[None]), (-1, 1, True, digest["c"])])


def test_exact_dedup_brute_force(corpus):
    rows, df = corpus
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()} == want


def test_exact_dedup_many_groups_and_one_hot_group(spark):
    rows = [(i, f"pair {i // 2}") for i in range(1200)] + [(i, "hot") for i in range(2000, 4000)] + [(i, f"alone {i}") for i in range(5000, 5300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def test_near_dedup_query_keeps_every_row_whose_id_names_the_component(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(7, long + " a"), (7, long + " b"), (9, long), (11, "other words here")], "doc_id long, text string")
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in queries.op1_near_dedup(spark, "").collect())
    assert got == [(7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True)]


# --- operator 6

def _lines_to_drop(rows):
    seen, out = [], defaultdict(list)
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = set(_words(line))
            if len(s) < line_dedup.MIN_TOKENS:
                continue
            if any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                out[i].append(k)
            seen.append(s)
    return dict(out)


def test_line_dedup_brute_force(corpus):
    rows, df = corpus
    want = _lines_to_drop(rows)
    texts = dict(rows)
    for r in line_dedup.line_dedup(df).collect():
        drop = want.get(r["doc_id"], [])
        assert r["dropped_lines"] == drop
        t = texts[r["doc_id"]]
        assert r["text"] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
        assert all(d <= r["doc_id"] for d in r["seen_in"]) and bool(r["seen_in"]) == bool(drop)


def test_line_dedup_query(spark, duck):
    want = _lines_to_drop(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: [int(x) for x in r["dropped"].split(",")] for r in queries.op6_line_dedup(spark, SF).collect() if r["n_dropped"]}
    assert got == want


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_line_dedup_compares_lines_of_few_words(spark, percent):
    """Brute force over every line that has a word."""
    rng = np.random.default_rng(33)
    vocab = ["a", "b", "c", "d", "e", "f", "春眠不觉晓处处闻啼鸟" * 20]
    lines = [" ".join(rng.choice(vocab, rng.integers(0, 9))) for _ in range(60)] + ["x " * 500, "| x | x |", "Menu", "a b c d", "d c b a e"]
    rows = [(i, "\n".join(rng.choice(lines, 4))) for i in range(40)]
    seen, want = [], defaultdict(list)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            s = set(_words(line))
            if s and any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                want[i].append(k)
            seen.append(s)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in got if r["dropped_lines"]} == want


def test_line_dedup_edges(spark, nothing):
    line = "one two three four five six"
    rows = [(1, line + "\n\n" + line), (1, line + "\n\n" + line), (2, "\n" + line + "\n"), (3, None), (4, ""), (None, line), (5, "A b c")]
    got = line_dedup.line_dedup(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, seen_in string")).collect()
    # nulls sort first, so the row without id has the first place
    assert sorted((r["doc_id"] or -1, r["text"], r["dropped_lines"]) for r in got if r["text"] is not None) == [
        (-1, line, []), (1, "", [0, 2]), (1, "", [0, 2]), (2, "\n", [1]), (4, "", []), (5, "A b c", [])]
    assert line_dedup.line_dedup(nothing).collect() == []


def _spied_tables(monkeypatch, name):
    """Rows of each stage table of that name."""
    seen, store = [], line_dedup.stored

    def spy(df, called):
        out = store(df, called)
        if called == name:
            seen.append({tuple(r) for r in out.collect()})
        return out
    monkeypatch.setattr(line_dedup, "stored", spy)
    return seen


def _long_lines():
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{k}" for k in rng.choice(900, 150, replace=False)) for _ in range(80)]
    near = lines[::10]
    return [(i, t) for i, t in enumerate(lines)] + [(100 + i, " ".join(["x", *t.split()[3:]])) for i, t in enumerate(near)]


def test_line_dedup_long_lines_that_only_share_words_are_no_candidates(spark, monkeypatch):
    rows = _long_lines()
    met = _spied_tables(monkeypatch, "met_pairs")
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in got if r["dropped_lines"]} == _lines_to_drop(rows)
    # 80 unrelated lines share words pair by pair; eight have a near copy
    assert len(set().union(*met)) <= 16


def test_line_dedup_meets_in_rounds(spark, monkeypatch):
    rows = _long_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = _spied_tables(monkeypatch, "met_pairs")
    line_dedup.line_dedup(df).collect()
    parts = list(met)
    assert len(parts) == line_dedup.ROUNDS > 1
    met.clear()
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    line_dedup.line_dedup(df).collect()
    assert set().union(*parts) == met[0]


def test_line_dedup_postings_travel_as_arrays_and_hot_tokens_are_split(spark, monkeypatch):
    rows = _long_lines() + [(200 + i, f"a b c d e{i}") for i in range(30)] + [(None, "a b c d f"), (None, "a b c d f g")]
    rows += [(400 + i, " ".join(["near", "copies", *"abcdefgh", f"z{i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = [(-1 if i is None else i, t) for i, t in rows]  # null ids come first
    met, seen = _spied_tables(monkeypatch, "met_pairs"), []

    def spy(sets, counts, *rest, by_token=line_dedup._by_token):
        out = by_token(sets, counts, *rest)
        seen.append((int(counts.sum()), out._df.count()))
        return out
    monkeypatch.setattr(line_dedup, "_by_token", spy)
    pairs = []
    for bucket, hot in ((line_dedup.BUCKET, line_dedup.HOT), (50, 3)):
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = line_dedup.line_dedup(df).collect()
        drops = defaultdict(list)
        for r in got:
            drops[-1 if r["doc_id"] is None else r["doc_id"]] += r["dropped_lines"]
        assert {i: d for i, d in drops.items() if d} == _lines_to_drop(own)
        pairs.append(set().union(*met))
        met.clear()
    assert pairs[0] == pairs[1]
    assert all(10 * n < postings for postings, n in seen[:line_dedup.LEADER_ROUNDS + line_dedup.ROUNDS])


@pytest.mark.parametrize("pivots", [1, 16])
def test_line_dedup_crowds_meet_their_pivots_first(spark, monkeypatch, pivots):
    # near copies of one line, each too far from most others; their sets meet no more than needed
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join([*rng.choice(words, int(rng.integers(34, 41)), replace=False), *(f"x{i}_{j}" for j in range(int(rng.integers(0, 6))))]) for i in range(60)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(lines)] + [(100 + i, " ".join(words + [f"y{i}"])) for i in range(40)]
    own = [(-1 if i is None else i, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs, tokens = _spied_tables(monkeypatch, "pairs"), _spied_tables(monkeypatch, "crowd")
    monkeypatch.setattr(line_dedup, "PIVOTS", pivots)
    for crowd in (256, 5):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        got = defaultdict(list)
        for r in line_dedup.line_dedup(df).collect():
            got[-1 if r["doc_id"] is None else r["doc_id"]].append((r["text"], r["dropped_lines"]))
        # rows of one id: equal lines are dropped alike
        seen, want = [], defaultdict(list)
        for i, t in own:
            if i >= 0:
                continue
            seen.append(set(_words(t)))
        for i, t in sorted(x for x in own if x[0] >= 0):
            near = any(100 * len(set(_words(t)) & x) >= 80 * len(set(_words(t)) | x) for x in seen)
            want[i] = [("" if near else t, [0] if near else [])]
            seen.append(set(_words(t)))
        assert {i: x for i, x in got.items() if i >= 0} == want
    assert len(pairs[1]) < len(pairs[0]) and not tokens[0] and tokens[1]


def test_line_dedup_reads_sets_of_first_places_and_marks_repeats_in_slices(spark, monkeypatch):
    # what the pairs need comes from the pairs: their sets are cut once and not looked up among all sets
    rows = _long_lines()
    seen, store = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: (seen.append(name), store(df, name))[1])
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").coalesce(1)
    got = line_dedup.line_dedup(df).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in got if r["dropped_lines"]} == _lines_to_drop(rows)
    assert seen.count("token_sets") == 1 and "wanted" not in seen and "open_sets" not in seen
    lines = line_dedup._lines(line_dedup.narrow(df).withColumn("version", F.xxhash64("text")), line_dedup.token_sketch(df), 80).collect()
    assert sum(r["c"] for r in lines) == len(lines) == 91 and sorted(r["c"] for r in lines) == [0] * 3 + [1] * 85 + [2] * 3
    assert all(not r["prefix"] for r in lines if not r["c"])


def test_token_sketch_counts_lines_and_travels_in_few_rows(spark):
    rows = [(1, "a b a\nb\n\nc"), (2, None), (3, "A  b"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = np.zeros(1 << line_dedup.SKETCH_BITS, np.int64)
    for word, n in (("a", 2), ("b", 3), ("c", 1)):
        data = np.frombuffer(word.encode(), np.uint8)
        want[line_dedup._slots(kernels.span_hashes(data, np.array([0]), np.array([len(data)])))] += n
    assert np.array_equal(line_dedup.token_sketch(df), want)
    assert line_dedup.SKETCH_ROW > 1


@pytest.mark.parametrize("text", ["b a b\n\na c\n \nc c", "a b a\n" * (1 << 18) + "b"])
def test_line_tokens_of_a_slice_by_the_slots_ranks(text):
    # the second text has more lines than the single sort takes
    import pyarrow as pa
    ranks = np.random.default_rng(1).permutation(1 << line_dedup.SKETCH_BITS).astype(np.uint64)
    (part,) = kernels.slices(pa.array(["", text]), 1 << 24)
    doc, number, tokens, first = line_dedup._line_tokens(part, ranks)
    lines = [(k, set(_words(x))) for k, x in enumerate(text.split("\n")) if _words(x)]
    assert set(doc) == {1} and number.tolist() == [k for k, _ in lines] and np.diff(first).tolist() == [len(x) for _, x in lines]
    hashed = {w: kernels.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([1]))[0] for w in "abc"}
    ordered = sorted("abc", key=lambda w: ranks[line_dedup._slots(hashed[w])])
    assert tokens[:first[4] if len(lines) > 4 else None].tolist() == [hashed[w] for _, x in lines[:4] for w in ordered if w in x]


# --- operator 7

def test_url_lists_intervals_and_matches(spark, nothing):
    d = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame([
        ("domain", "Bad.org", d(5), "add", 1), ("domain", "bad.org", d(10), "remove", 1), ("domain", "bad.org", d(20), "add", 1),
        ("domain", "bad.org", d(20), "remove", 1), ("host", "a.b.c", d(1), "add", 1), ("prefix", "ok.net/x", d(3), "add", 1),
        ("host", None, d(1), "add", 1), ("host", "q", d(1), "other", 1), ("host", "q", None, "add", 1), ("host", "gone.com", d(1), "remove", 1)],
        "kind string, value string, day date, action string, spans int")
    urls = ["http://www.bad.org/p", "https://u:p@BAD.org.:80/", "//a.b.c?x", "http://z.a.b.c/", "http://ok.net/X/y", "http://ok.net/z", None, "", "nonsense",
            "http://notbad.org/"]
    caps = spark.createDataFrame([(i, u, d(n), "k") for n in (4, 5, 9, 10, 25) for i, u in enumerate(urls)] + [(99, urls[0], None, "k"), (0, urls[0], d(5), "k")],
                                 "page_id long, url string, day date, kind string")
    got = defaultdict(list)
    for r in url_lists.match(caps, entries).collect():
        got[r["page_id"], r["day"].day if r["day"] else 0].append(r["matches"])
    bad = {4: "", 5: "domain:bad.org", 9: "domain:bad.org", 10: "", 25: "domain:bad.org"}
    for n, m in bad.items():
        assert set(got[0, n]) == {m} and got[1, n] == [m]
        assert got[2, n] == ["host:a.b.c"] and got[3, n] == [""] and got[4, n] == ["prefix:ok.net/x"]
        assert all(got[i, n] == [""] for i in (5, 6, 7, 8, 9))
    assert got[99, 0] == [""] and len(got[0, 5]) == 2
    assert url_lists.match(caps.where("false"), entries).collect() == []
    assert not any(r["blocked"] for r in url_lists.match(caps, entries.where("false")).collect())


def test_key_sums_do_not_depend_on_order():
    v = np.arange(10, dtype=np.uint64)
    f = np.array([0, 4, 10])
    assert np.array_equal(kernels.set_keys(v, f), kernels.set_keys(np.concatenate([v[:4][::-1], v[4:]]), f))


def test_url_lists_last_label_and_long_hosts(spark):
    long = ".".join(["a"] * 200) + ".example.org"
    urls = ["http://x.zip/p", "http://zip/", "http://x.zippo/", f"http://{long}/"]
    captures = spark.createDataFrame([(i, u, date(2024, 5, 1)) for i, u in enumerate(urls)], "page_id long, url string, day date")
    entries = spark.createDataFrame([("domain", v, date(2024, 1, 1), "add") for v in ("zip", "example.org", "a." * 150 + "example.org")],
                                    "kind string, value string, day date, action string")
    got = {r["page_id"]: r["n_matches"] for r in url_lists.match(captures, entries).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 2}
