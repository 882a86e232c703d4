"""Operator 10: secret scans with one combined deterministic automaton.

All rules are compiled into one automaton (see automaton.py) and every byte of every text is read once.  A batch of
texts is one buffer, texts parted by a byte that UTF-8 never holds.  Where a rule has matched, the exact spans of that
rule are read off the line around the match (no rule can span a resetting byte), leftmost and non-overlapping.

Defined results: null counts as empty and has no spans; offsets are code points, end exclusive; every row is scanned
whole, repeated rows alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spotweave.llm.automaton import Dfa
from spotweave.llm.common import narrow_batches, slices, text_bytes


@dataclass(frozen=True)
class Rule:
    """exact: the pattern whose leftmost non-overlapping matches count, if `group` of it has `least` characters or more.
    scan: what the automaton looks for: a prefix that every counting match has."""

    kind: str
    exact: str
    scan: str
    group: int = 0
    least: int = 0
    either_case: bool = False
    base: bool = False


# The rules.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24, False, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{4}", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{4}", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]"),
)
PARTING = 0xFF
#: Bytes scanned as one buffer.
BUFFER = 4 << 20


@lru_cache(4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, list[re.Pattern]]:
    dfa = Dfa([(r.scan, r.either_case) for r in rules])
    assert dfa.resets[PARTING]
    return dfa, [re.compile(r.exact, (re.IGNORECASE if r.either_case else 0) | re.ASCII) for r in rules]


def spans_of(raw: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES, automaton=None) -> dict[int, list[tuple[int, int, str]]]:
    """Row -> its (start, end, kind) in code points, by start and then as kinds are listed; rows without any are left out."""
    dfa, patterns = automaton or compiled(rules)
    rows = len(offsets) - 1
    buffer = np.full(len(raw) + rows, PARTING, np.uint8)
    buffer[np.arange(len(raw)) + np.repeat(np.arange(rows), np.diff(offsets))] = raw
    firsts = offsets + np.arange(rows + 1)  # of texts in the buffer
    at, marks = dfa.scan(buffer)
    if not len(at):
        return {}
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80, dtype=np.int64)])  # code points before a byte
    resets = np.concatenate([[-1], np.flatnonzero(dfa.resets[buffer])])
    line = np.searchsorted(resets, at) - 1  # the last resetting byte before the match
    found: dict[int, list[tuple[int, int, str]]] = {}
    lines, place = np.unique(line, return_inverse=True)
    told = np.zeros(len(lines), np.int64)
    np.bitwise_or.at(told, place.reshape(-1), marks)
    for k, bits in zip(lines.tolist(), told.tolist(), strict=True):
        a, b = int(resets[k]) + 1, int(resets[k + 1]) if k + 1 < len(resets) else len(buffer)
        row = int(np.searchsorted(firsts, a, "right")) - 1
        shift = int(points[a] - points[firsts[row]])
        text = buffer[a:b].tobytes().decode("utf-8", "surrogatepass")
        for n, (rule, pattern) in enumerate(zip(rules, patterns, strict=True)):
            if bits >> n & 1:
                for m in pattern.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found.setdefault(row, []).append((shift + m.start(), shift + m.end(), rule.kind))
    rank = {r.kind: n for n, r in enumerate(rules)}
    return {row: sorted(s, key=lambda x: (x[0], rank[x[2]])) for row, s in found.items()}


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row."""
    narrow_batches(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # a few MB, by the rules alone
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for lo, hi in slices(offsets, BUFFER):
                for row, spans in spans_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rules, automaton.value).items():
                    out[lo + row] = [{"kind": k, "start": a, "end": e} for a, e, k in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
