"""Secret scan (operator 10): fixed patterns plus dictionary-primed zstandard novelty.

Base kinds are regular expressions over the whole text. The method adds spans of
kind ``novel``: a long token after a sensitive word is a candidate; its novelty is
the number of bytes it adds to a zstandard frame that is primed with a dictionary
of identifiers and already holds the text around it. A name, a path or a repeated
string costs little; a random string costs what any string of its length over its own
characters costs at that place, and is reported. Rows are independent, so there is no
shuffle."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from posttrain.llm.common import ID, TEXT, arrow_map, narrow


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed patterns of the base kinds.
_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the maximal runs that pass
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile("|".join(_either_case(w) for w in (
    "password", "passwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "login", "signature")))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
MIN_CHARS, REACH, AROUND = 16, 40, 200
#: A token is novel if it adds ``NOVELTY`` of the bytes that random strings over its own
#: characters add (the mean of ``REFERENCES``), and ``LEAST`` bytes a byte: random hex
#: digits, the smallest alphabet of a secret, add 0.5 at any length.
NOVELTY, REFERENCES, LEAST = 0.95, 4, 0.45

#: Identifiers that prime the dictionary.
IDENTIFIERS = (
    "authenticate authentication authorization authorized bearer certificate client client_id client_secret config "
    "configuration connection content context credential credentials database default description document element "
    "encoding environment example exception expires function handler header headers identifier identity import "
    "index instance interface internal kubernetes length license localhost login manager message metadata method "
    "module namespace network number object option options package parameter parameters password path permission "
    "private private_key property protocol provider public public_key query reference register repository request "
    "resource response return schema secret secret_key security select server service session settings signature "
    "source static status storage string structure subscription system template timeout timestamp token token_type "
    "transaction update username validation value variable version virtual workspace abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 ffffffffffffffffffffffffffffffff "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx ................................ --------------------------------")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return spans


class Novelty:
    """Marginal compressed bytes of a token, against identifiers and surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard
        raw = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(
            level=19, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def is_novel(self, text: str, start: int, end: int) -> bool:
        around = (text[max(0, start - AROUND):start] + "\n" + text[end:end + AROUND]).encode()
        token = text[start:end]
        before = len(self.compress(around))
        added = len(self.compress(around + token.encode())) - before
        if added < LEAST * len(token):
            return False
        # the same strings for the same token, on every machine
        letters, draw = sorted(set(token)), random.Random(token)
        usual = sum(len(self.compress(around + "".join(draw.choices(letters, k=len(token))).encode())) - before for _ in range(REFERENCES))
        return added * REFERENCES >= NOVELTY * usual


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible tokens after a sensitive word that no base span touches.
    They have digits and letters and start within ``REACH`` characters. Of spans that
    overlap (a token after or around several sensitive words) the longest stays: words
    are taken in order, so it comes first."""
    out, seen = [], set()
    for word in SENSITIVE.finditer(text):
        at = word.end()
        for m in CANDIDATE.finditer(text, at):
            if m.start() > at + REACH:
                break
            s, e = m.span()
            if e - s < MIN_CHARS or s in seen or (out and s < out[-1][2]) or any(a < e and s < b for a, _, b in taken):
                continue
            seen.add(s)
            token = m[0]
            if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and novelty.is_novel(text, s, e):
                out.append((s, 3, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, identifiers: str = IDENTIFIERS) -> DataFrame:
    """``doc_id, kinds array<string>, starts array<long>, ends array<long>`` per
    input row: all spans by start, then kind; code points, end exclusive. A null or
    empty text has none. Repeated rows give a row each, an empty table gives none;
    other columns are ignored."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        kinds, starts, ends = [], [], []
        for t in batch.column(1).to_pylist():
            base = base_spans(t) if t else []
            spans = sorted(base + novel_spans(t, base, novelty)) if t else []
            kinds.append([KINDS[k] for _, k, _ in spans])
            starts.append([s for s, _, _ in spans])
            ends.append([e for _, _, e in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())),
             pa.array(ends, pa.list_(pa.int64()))], names=[ID, "kinds", "starts", "ends"])

    return arrow_map(narrow(docs, id_col, text_col), run,
                     f"{ID} long, kinds array<string>, starts array<long>, ends array<long>")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
