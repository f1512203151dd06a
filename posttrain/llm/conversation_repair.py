"""Conversation structure repair by run-length dynamic programming (operator 12).

Rows of a conversation are edited so that the initials of the roles read
``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an
empty user or assistant turn, anywhere) 2; a truncated row that is not deleted adds 1;
a blank or duplicate row must be deleted.

1. Faults are columns; repeats are found by a sum over (conversation, role, text)
   joined back, so one frequent turn is no hot group.
2. A row is a symbol: its role's class and its fault. Rows stream through their task in
   order; equal consecutive symbols are collapsed to a run.
3. The four states of the pattern make each symbol a 4 x 4 min-plus matrix. The costs
   to go are carried backwards over each run through cached binary powers of its
   matrix: log2(length) products a run.
4. The audit is unrolled forwards: the smallest letter that keeps to the optimal cost,
   for all states that share the letters so far.
5. A second streamed pass applies each audit to its conversation's texts. A task holds
   the runs and the audit of one conversation, never its texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttrain.llm.common import ship_package, stored

CONV, TURN, ROLE = "conv_id", "turn", "role"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40
#: States of the pattern: nothing yet, after s, after u, after a; moves by initial.
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)
_STATES = 4
#: Symbols: "-" must go; else the role's class (x: no legal one), and "!" if truncated.
_MUST_GO = "-"
#: Rows of a run whose costs to go are held at once.
BLOCK = 1024


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


@cache
def _inserts() -> np.ndarray:
    """Cheapest insertions from state to state."""
    step = np.full((_STATES, _STATES), NEVER, np.int64)
    np.fill_diagonal(step, 0)
    for x in "ua":
        for a, b in _MOVES[x].items():
            step[a, b] = INSERT
    return _product(_product(step, step), _product(step, step))


def _options(symbol: str) -> list[tuple[str, int, dict[int, int]]]:
    """Edits of a row: letter, cost, moves."""
    out = [("D", DELETE, {s: s for s in range(_STATES)})]
    if symbol != _MUST_GO:
        more = TRUNCATED if symbol.endswith("!") else 0
        if symbol[0] in _MOVES:
            out.append(("K", more, _MOVES[symbol[0]]))
        out += [("R", REROLE + more, _MOVES[x]) for x in "ua"]
    return out


@cache
def _power(symbol: str, k: int) -> np.ndarray:
    """Min-plus matrix of ``2^k`` rows of a symbol, insertions before them included."""
    if k:
        half = _power(symbol, k - 1)
        return _product(half, half)
    step = np.full((_STATES, _STATES), NEVER, np.int64)
    for _, cost, moves in _options(symbol):
        for a, b in moves.items():
            step[a, b] = min(step[a, b], cost)
    return _product(_inserts(), step)


def _before(symbol: str, length: int, after: np.ndarray) -> np.ndarray:
    """Costs to go before ``length`` equal rows, from those after them."""
    k = 0
    while length:
        if length & 1:
            after = np.minimum((_power(symbol, k) + after).min(axis=1), NEVER)
        length >>= 1
        k += 1
    return after


def _to_go(runs: list[tuple[str, int]], ends: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Row by row: symbol, costs to go before it, and after it."""
    for (symbol, length), after in zip(runs, ends, strict=True):
        for at in range(0, length, BLOCK):
            size = min(BLOCK, length - at)
            costs = [_before(symbol, length - at - size, after)]
            for _ in range(size):
                costs.append(_before(symbol, 1, costs[-1]))
            for j in range(size, 0, -1):
                yield symbol, costs[j], costs[j - 1]


def plan(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost and ASCII-least audit (letters D, I, K, R) of a conversation given as
    runs of symbols."""
    last = np.array([min(_inserts()[s, e] for e in _ENDS) for s in range(_STATES)])
    ends = [last]
    for symbol, length in reversed(runs):
        ends.append(_before(symbol, length, ends[-1]))
    total, ends = int(ends[-1][0]), ends[-2::-1]
    at, audit = {0: 0}, []  # states with the letters so far: cost so far

    def moved(states: dict[int, int], cost: int, moves: dict[int, int], to_go: np.ndarray) -> dict[int, int]:
        return {moves[s]: c + cost for s, c in states.items() if s in moves and c + cost + to_go[moves[s]] == total}

    def inserted(states: dict[int, int], to_go: np.ndarray) -> dict[int, int]:
        return moved(states, INSERT, _MOVES["u"], to_go) | moved(states, INSERT, _MOVES["a"], to_go)

    for symbol, here, after in _to_go(runs, ends):
        options = _options(symbol)
        while True:
            after_row = {letter: {} for letter, _, _ in options}
            for letter, cost, moves in options:
                after_row[letter] |= moved(at, cost, moves, after)
            if after_row["D"]:
                audit.append("D")
                at = after_row["D"]
                break
            if more := inserted(at, here):
                audit.append("I")
                at = more
                continue
            letter = min(x for x, states in after_row.items() if states)
            audit.append(letter)
            at = after_row[letter]
            break
    while not any(s in _ENDS and c == total for s, c in at.items()):
        audit.append("I")
        at = inserted(at, last)
    return total, "".join(audit)


def marked(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (nulls of the last two: one space), ``gone`` and the
    faults ``blank, truncated, again`` (said at an earlier turn), ``same`` (its name)."""
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    name = F.md5(F.concat(F.coalesce(F.col(CONV).cast("string"), F.lit(" ")), F.lit(":"), F.length(ROLE).cast("string"), F.lit(":"), ROLE, "text").cast("binary"))
    rows = rows.withColumn("blank", ~words).withColumn("truncated", ~whole).withColumn("same", name)
    turn = F.struct(F.col(TURN).isNotNull().alias("known"), F.col(TURN).alias("turn"))  # nulls first
    said = (rows.where("NOT gone AND NOT blank").groupBy("same").agg(F.min(turn).alias("first_said"), F.count("*").alias("n"))
            .where("n > 1").drop("n"))
    return (rows.join(said, "same", "left")
            .withColumn("again", F.coalesce(turn > F.col("first_said"), F.lit(False))).drop("first_said"))


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Whole conversations in order, each within one task."""
    spark = rows.sparkSession
    ship_package(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, CONV).sortWithinPartitions(CONV, *order)


class _Conversation:
    """Counts and runs of one conversation, row by row."""

    def __init__(self) -> None:
        self.runs: list[list] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = self.before = None

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, again: bool, same: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        # equal rows of one turn are neighbours
        duplicate = not blank and (again or self.before == (turn, same))
        self.before = (turn, same)
        self.blank += blank
        self.duplicate += duplicate
        cut = truncated and not blank and not duplicate
        self.truncated += cut
        symbol = _MUST_GO if blank or duplicate else initial + "!" * cut
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *plan([tuple(r) for r in self.runs])


_AUDIT_TYPES = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]


def audits(faulty: DataFrame) -> DataFrame:
    """One row per conversation of ``marked`` rows: counts of faults, cost and audit."""
    initial = F.when(F.col(ROLE).rlike("^[sua]"), F.substring(ROLE, 1, 1)).otherwise("x")
    rows = (_dealt(faulty, TURN, ROLE, "text", "gone")
            .select(CONV, TURN, initial.alias("initial"), "blank", "truncated", "again", "same", "gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in done], t) for i, t in enumerate([kind, *(t for _, t in _AUDIT_TYPES)])]
            return pa.RecordBatch.from_arrays(arrays, names=[CONV, *(n for n, _ in _AUDIT_TYPES)])

        now, open_, kind = None, None, pa.int64()
        for batch in batches:
            done = []
            for conv, turn, *rest, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv != now:
                    if open_ is not None:
                        done.append((now, *open_.row()))
                    now, open_ = conv, _Conversation()
                if not gone:
                    open_.add(turn, *rest)
            yield told(done)
        if open_ is not None:
            yield told([(now, *open_.row())])

    fields = ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n, _ in _AUDIT_TYPES)
    return rows.mapInArrow(run, f"{CONV} long, {fields}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch: ``(conv_id, number, role, text)`` of the repaired rows; number -1 opens
    a conversation. Audits come before the rows of their conversation."""
    audit, at, number, shift, now, pending = "", 0, 0, 0, None, False

    def role(no: int) -> str:
        return "assistant" if (no - shift) % 2 else "user"

    def inserts(out: list) -> None:
        nonlocal at, number
        while at < len(audit) and audit[at] == "I":
            out.append((now, number, role(number), ""))
            at, number = at + 1, number + 1

    for batch in batches:
        out: list[tuple] = []
        for conv, kind, r, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                if pending:
                    inserts(out)
                now, audit, at, number, pending = conv, text, 0, 0, True
                shift = (len(audit) - audit.count("D")) % 2  # an odd number of rows opens with a system turn
                out.append((now, -1, None, None))
                continue
            inserts(out)
            letter, at = audit[at], at + 1
            if letter != "D":
                out.append((now, number, r if letter == "K" else role(number), text))
                number += 1
        yield out
    if pending:
        last: list[tuple] = []
        inserts(last)
        yield last


def _with_audits(faulty: DataFrame, found: DataFrame) -> DataFrame:
    heads = found.select(CONV, F.lit(0).alias("kind"), F.lit(None).cast("long").alias(TURN), F.lit(None).cast("string").alias(ROLE), F.col("audit").alias("text"))
    body = faulty.where("NOT gone").select(CONV, F.lit(1).alias("kind"), F.col(TURN).cast("long").alias(TURN), ROLE, "text")
    return _dealt(heads.unionByName(body), "kind", TURN, ROLE, "text").select(CONV, "kind", ROLE, "text")


def repaired_turns(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, number, role, text``: the repaired rows, numbered from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _edited(batches):
            rows = [r for r in rows if r[1] >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             names=[CONV, "number", ROLE, "text"])

    return _with_audits(faulty, found).mapInArrow(run, f"{CONV} long, number long, {ROLE} string, text string")


def repaired_digests(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of each conversation's repaired ``role:text``
    lines, taken while they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.string())], names=[CONV, "repaired_sha256"])

        now, total = None, None
        for rows in _edited(batches):
            done = []
            for conv, number, role, text in rows:
                if number < 0:
                    if total is not None:
                        done.append((now, total.hexdigest()))
                    now, total = conv, hashlib.sha256()
                else:
                    total.update(f"{chr(10) if number else ''}{role}:{text}".encode())
            yield told(done)
        if total is not None:
            yield told([(now, total.hexdigest())])

    return _with_audits(faulty, found).mapInArrow(run, f"{CONV} long, repaired_sha256 string")


def faulty_rows(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text`` rows, ready for ``audits`` and ``repaired_turns``.
    ``gone`` marks rows that are not there but whose conversation is to be reported.

    Rows are taken by turn (nulls first), equal turns by role, then text; equal rows of
    one turn are duplicates of their first. Null roles and texts are one space: such a
    text is blank. A role that does not begin with s, u or a (an empty one too) can't be
    kept. Rows without conv_id are one conversation of their own. A conversation
    without rows has cost 0 and an empty audit. Other columns are left out, whatever
    their names; an empty table gives no rows."""
    ship_package(rows.sparkSession)
    gone = F.lit(False) if gone is None else gone
    out = rows.select(F.col(CONV).cast("long").alias(CONV), F.col(TURN).cast("long").alias(TURN), F.coalesce(F.col(ROLE).cast("string"), F.lit(" ")).alias(ROLE),
                      F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    return stored(marked(out), "marked_turns")
