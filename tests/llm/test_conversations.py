"""Conversation operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pytest

from posttrain.llm import conversation_repair, prefix_trie, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def _damaged(rows):
    """conv -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        a, b, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{a}:{b}".encode()) % 20
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def _optimal(rows):
    """All cheapest edit sequences by search with no shared code: (cost, letters, repaired rows)."""
    ok = re.compile("(s?(ua)+)?$")
    prefix = re.compile("s?(ua)*u?$")
    best = [3 * len(rows) + 1, []]

    def go(i, cost, letters, out):
        if cost > best[0] or not prefix.match("".join(x[0][:1] for x in out)):
            return
        if i == len(rows) and ok.match("".join(x[0][:1] for x in out)):
            if cost < best[0]:
                best[0], best[1] = cost, []
            best[1].append((letters, out))
        if i < len(rows):
            role, text, fault = rows[i]
            more = fault == "t"
            if fault != "x":
                go(i + 1, cost + more, letters + "K", [*out, (role, text)])
            go(i + 1, cost + 3, letters + "D", out)
            if fault != "x":
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, letters + "R", [*out, (r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 2, letters + "I", [*out, (r, "")])

    go(0, 0, "", [])
    letters, out = min(best[1])
    return best[0], letters, out


def _brute(conv, rows):
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faults.append((role, text, {"truncated": "t", None: ""}.get(fault, "x")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, out = _optimal(faults)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return {"conv_id": conv, "gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def _repair_key(r):
    return r["conv_id"] is not None, r["conv_id"] or 0


def test_repair_query(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = sorted((r.asDict() for r in queries.op12_conversation_repair(spark, SF).collect()), key=_repair_key)
    assert got == sorted((_brute(c, r) for c, r in _damaged(rows).items()), key=_repair_key)


@pytest.mark.parametrize("seed", range(3))
def test_plan_against_all_edits(seed):
    rng = np.random.default_rng(seed)
    for _ in range(120):
        symbols = [str(x) for x in rng.choice(["-", "s", "u", "a", "x", "s!", "u!", "a!", "x!"], rng.integers(0, 6))]
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        rows = [("user" if x == "-" else names[x[0]], "t", "x" if x == "-" else "t" if x.endswith("!") else "") for x in symbols]
        cost, audit, _ = _optimal(rows)
        runs = [(k, len(list(g))) for k, g in groupby(symbols)]
        assert conversation_repair.plan(runs) == (cost, audit), symbols


def test_plan_of_long_runs():
    # a run longer than a block: every second user is deleted or rerolled, or answered
    n = 2 * conversation_repair.BLOCK + 77
    cost, audit = conversation_repair.plan([("u", n)])
    assert (cost, len(audit.replace("I", ""))) == (n + 1, n) and audit.count("D") == 0
    assert conversation_repair.plan([("-", n)]) == (3 * n, "D" * n)
    assert conversation_repair.plan([]) == (0, "")


def test_repair_of_odd_rows(spark):
    rows = [(1, None, "user", "a."), (1, 0, "assistant", "b."), (1, 0, "assistant", "b."), (None, 3, "user", "x."), (None, 9, None, None),
            (2, 5, "user", "  \n"), (3, 1, "", "no role."), (4, 7, "system", "one!"), (4, 9, "user", "two "), (5, None, "user", "q?"), (5, None, "assistant", "r")]
    df = spark.createDataFrame([(*r, "k", 1.5) for r in rows], "conv_id long, turn long, role string, text string, same string, cost double").repartition(5)
    faulty = conversation_repair.faulty_rows(df)
    found = conversation_repair.audits(faulty)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in found.collect()}
    assert got == {1: (0, 0, 1, 0, 1, 3, "KKD"), None: (5, 1, 0, 0, 1, 5, "KDI"), 2: (0, 1, 0, 0, 0, 3, "D"),
                   3: (0, 0, 0, 0, 0, 3, "D"), 4: (1, 0, 0, 1, 0, 3, "KKI"), 5: (0, 0, 0, 1, 0, 5, "DKI")}
    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(faulty, found).orderBy("conv_id", "number").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert turns[1] == [("user", "a."), ("assistant", "b.")]
    assert turns[None] == [("user", "x."), ("assistant", "")]
    assert turns[4] == [("system", "one!"), ("user", "two "), ("assistant", "")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    faulty = conversation_repair.faulty_rows(none)
    found = conversation_repair.audits(faulty)
    assert found.collect() == [] and conversation_repair.repaired_digests(faulty, found).collect() == []


# --- operator 13

def _trie(convs):
    """Nodes of conv -> list of turns, by plain recursion over prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def totals(p):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = 0 if children[p] else 1
        for x in children[p]:
            a, b = totals(x)
            saved, leaves = saved + a, leaves + b
        return saved, leaves

    out = []
    for p, m in list(members.items()):
        saved, leaves = totals(p)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=str)


def test_trie_query(spark, duck):
    own = defaultdict(list)
    for c, turn, role, text in duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert _rows(queries.op13_prefix_trie(spark, SF)) == _trie(built)


def test_trie_of_many_shapes(spark):
    rng = np.random.default_rng(3)
    convs = {}
    for c in range(70):
        base = list(convs[int(rng.integers(0, c))]) if c and rng.random() < 0.8 else []
        convs[c] = base[:int(rng.integers(0, 12))] + [("user", f"é{rng.integers(0, 3)}") for _ in range(int(rng.integers(0, 4)))]
    convs[1000] = [("user", f"{i}") for i in range(150)]
    convs[1001] = convs[1000][:100] + [("a", "x")]
    convs[5000] = list(convs[1000])
    convs[-4] = [("", ""), ("", "")]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    members = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = prefix_trie.prefix_trie(df, members)
    assert _rows(got) == _trie(convs)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "b", "x"), (1, 2, "a", "y"), (None, 0, "a", "lost"), (2, 0, "", ""), (2, 1, "a", "y"), (2, 1, "a", "y")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
    want = _trie({1: [("", ""), ("a", "y"), ("b", "x")], 2: [("", ""), ("a", "y"), ("a", "y")]})
    assert _rows(prefix_trie.prefix_trie(df)) == want
    assert prefix_trie.prefix_trie(df.where("false")).collect() == []


def test_subtree_totals_of_random_trees(spark):
    rng = np.random.default_rng(11)
    for shape in ("random", "chain", "star", "brush"):
        n = 200
        parent = {i: {"random": int(rng.integers(0, i)), "chain": i - 1, "star": 0, "brush": i - 1 if i % 2 else max(i - 2, 0)}[shape] for i in range(1, n)}
        weight = rng.integers(0, 50, n)
        total, leaves = weight.astype(int).tolist(), [int(i not in set(parent.values())) for i in range(n)]
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
            leaves[parent[i]] += leaves[i]
        df = spark.createDataFrame([(str(i).encode(), str(parent[i]).encode() if i else None, int(weight[i])) for i in range(n)], "node binary, parent binary, weight long")
        got = {int(r["node"]): (r["w"], r["l"]) for r in prefix_trie.subtree_totals(df).collect()}
        assert got == {i: (total[i], leaves[i]) for i in range(n)}, shape
