"""Secret scan: all rules compiled into one minimised deterministic automaton that reads each byte once.

The rules are parsed into a Thompson automaton over bytes, joined by an unanchored start, determinised by subset construction over
byte classes and minimised by partition refinement. One pass over a text tells where matches of each rule end. From the last place of
each run of ends, the rule's reversed automaton goes back to the leftmost start behind the match before it, so spans are the rule's
leftmost non-overlapping matches; every rule ends in a repetition of one class (or in fixed text), so all matches that overlap a run end
with it. The expression itself only measures the group whose length counts, on the span alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, widened

#: kind -> (pattern, group whose length counts, least length). Fixed values of the contract.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Further rules of this operator.
MORE = {
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 0, 20),
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
RULES = {**BASE, **MORE}
CASELESS = {"assign"}
#: Rules whose least length is part of the automaton, as shorter matches stand in no other's way; else the span check has it.
COUNTED = {"hex"}


def expression(kind: str) -> re.Pattern[bytes]:
    return re.compile(RULES[kind][0].encode(), re.IGNORECASE if kind in CASELESS else 0)


# --- regular expression to automaton -------------------------------------------------------------------------------------------


class Parser:
    """Thompson construction for literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``. Letters in groups that are
    keywords may stand in either case where ``caseless`` is set."""

    def __init__(self, pattern: str, nfa: list, caseless: bool):
        self.p, self.i, self.nfa, self.caseless = pattern, 0, nfa, caseless

    def state(self) -> int:
        self.nfa.append([])  # edges: (bytes or None, target)
        return len(self.nfa) - 1

    def parse(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            first, last = self.sequence()
            self.nfa[start].append((None, first))
            self.nfa[last].append((None, end))
            if self.i >= len(self.p) or self.p[self.i] != "|":
                return start, end
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            begin = self.i
            a, b = self.atom()
            if self.i < len(self.p) and self.p[self.i] in "?*+":
                mark = self.p[self.i]
                self.i += 1
                if mark != "?":
                    self.nfa[b].append((None, a))
                if mark != "+":
                    self.nfa[a].append((None, b))
            assert self.i > begin
            self.nfa[last].append((None, a))
            last = self.state()
            self.nfa[b].append((None, last))
        return first, last

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            a, b = self.parse()
            self.i += 1
            start, end = self.state(), self.state()
            self.nfa[start].append((None, a))
            self.nfa[b].append((None, end))
            return start, end
        chars = self.chars() if c == "[" else self.folded(frozenset({self.char()}))
        a, b = self.state(), self.state()
        self.nfa[a].append((chars, b))
        return a, b

    def folded(self, chars: frozenset[int]) -> frozenset[int]:
        return chars | {x ^ 32 for x in chars if chr(x).isalpha()} if self.caseless else chars

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def chars(self) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        while self.p[self.i] != "]":
            low = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out.update(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(out)


def _closure(nfa: list, states: frozenset[int]) -> frozenset[int]:
    seen, todo = set(states), list(states)
    while todo:
        for chars, t in nfa[todo.pop()]:
            if chars is None and t not in seen:
                seen.add(t)
                todo.append(t)
    return frozenset(seen)


def least(kind: str) -> str:
    """The rule's pattern with its final repetition written out to the least length, so that only full matches are accepted."""
    pattern, group, n = RULES[kind]
    if not pattern.endswith(("+", "+)")) or not n:
        return pattern
    body = pattern.rstrip(")").removesuffix("+")
    last = body[body.rindex("[") :]
    fixed = 0 if group else len(re.match(r"\w*", pattern)[0])
    tail = last * max(0, n - fixed - 1) if kind in COUNTED else ""
    return body + tail + "+" + (")" if pattern.endswith(")") else "")


@lru_cache(1)
def automaton() -> tuple[list[int], int, dict[int, tuple[str, ...]]]:
    """Transition array (state + byte -> state, states being multiples of 256), first accepting state, rules of each of those."""
    nfa: list = [[]]
    accepts: dict[int, str] = {}
    for kind in RULES:
        start, end = Parser(least(kind), nfa, kind in CASELESS).parse()
        nfa[0].append((None, start))
        accepts[end] = kind
    sets = {chars for edges in nfa for chars, _ in edges if chars}
    classes: dict[tuple, int] = {}
    of = [classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)]
    byte = {c: of.index(c) for c in range(len(classes))}
    start = _closure(nfa, frozenset({0}))
    number, todo, table = {start: 0}, [start], []
    while todo:
        now, nexts = todo.pop(0), []
        for c in range(len(classes)):
            # unanchored: a match may begin anywhere
            to = _closure(nfa, frozenset(t for q in now for chars, t in nfa[q] if chars and byte[c] in chars) | {0})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            nexts.append(number[to])
        table.append(nexts)
    label = {i: tuple(sorted(accepts[q] for q in s if q in accepts)) for s, i in number.items()}
    part = _minimised(table, label)
    order = sorted(set(part), key=lambda p: (bool(label[part.index(p)]), part[0] != p))
    new = {p: i for i, p in enumerate(order)}
    rows = {new[part[i]]: [new[part[t]] for t in table[i]] for i in range(len(table))}
    flat = [rows[s][of[b]] * 256 for s in range(len(rows)) for b in range(256)]
    kinds = {new[part[i]] * 256: label[i] for i in range(len(table)) if label[i]}
    return flat, min(kinds, default=len(flat)), kinds


def _minimised(table: list[list[int]], label: dict[int, tuple]) -> list[int]:
    """Block of each state, refined until no block splits."""
    part = [sorted(set(label.values())).index(label[i]) for i in range(len(table))]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[i], *(part[t] for t in row)), len(seen)) for i, row in enumerate(table)]
        if len(seen) == len(set(part)):
            return new
        part = new


@lru_cache(16)
def reversed_automaton(kind: str) -> tuple[list, frozenset[int], int, dict]:
    """Edges of the rule's automaton against their direction, its states before any byte, its accepting state, and steps met so far."""
    nfa: list = []
    start, end = Parser(least(kind), nfa, kind in CASELESS).parse()
    back: list = [[] for _ in nfa]
    for q, edges in enumerate(nfa):
        for chars, t in edges:
            back[t].append((chars, q))
    return back, _closure(back, frozenset({end})), start, {}


def begin(text: bytes, kind: str, end: int, least_begin: int) -> int | None:
    """The leftmost start, not before ``least_begin``, of a match of the rule that ends at ``end``."""
    back, states, start, steps = reversed_automaton(kind)
    found = None
    for i in range(end - 1, least_begin - 1, -1):
        key = (states, text[i])
        if key not in steps:
            steps[key] = _closure(back, frozenset(t for q in states for chars, t in back[q] if chars and text[i] in chars))
        states = steps[key]
        if not states:
            break
        if start in states:
            found = i
    return found


def ends(text: bytes, tables: tuple) -> dict[str, list[int]]:
    """The ends of matches of each rule that a longer one doesn't follow at once, from one pass over the bytes."""
    table, accepting, kinds = tables
    state, met = 0, []
    note = met.append
    for i, byte in enumerate(text, 1):
        state = table[state + byte]
        if state >= accepting:
            note((i, state))
    out: dict[str, list[int]] = {}
    for i, s in met:
        for kind in kinds[s]:
            places = out.setdefault(kind, [])
            if places and places[-1] == i - 1:
                places[-1] = i
            else:
                places.append(i)
    return out


def spans(text: bytes, tables: tuple | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    met = ends(text, tables or automaton())
    if not met:
        return []
    out = []
    for k, kind in enumerate(RULES):
        _, group, n = RULES[kind]
        before = 0
        for end in met.get(kind, ()):
            start = begin(text, kind, end, before)
            if start is not None:
                before = end
                if end - start >= n and len(expression(kind).fullmatch(text, start, end)[group]) >= n:
                    out.append((start, k, kind, end))
    if text.isascii():
        return [(kind, a, b) for a, _, kind, b in sorted(out)]
    # code points before each byte
    place = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))).tolist()
    return [(kind, place[a], place[b]) for a, _, kind, b in sorted(out)]


def secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``, an array of (kind, begin, until) in code points, the end exclusive.

    A null or empty text has none. Every row keeps its place; a column named ``found`` is replaced.
    """
    kept = docs.drop("found")
    names, key = kept.columns, "_text"
    while key in names:
        key += "_"
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("until", pa.int64())]))
    schema = widened(kept.schema, "found array<struct<kind:string,begin:bigint,until:bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = automaton()
        for b in slices(batches, key):
            found = [[{"kind": k, "begin": s, "until": e} for k, s, e in spans(t, tables)] for t in utf8(b.column(key))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(found, span)], names=[*names, "found"])

    return kept.withColumn(key, F.col(text_col).cast("string")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and text form of the spans of each row of ``secrets``."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["until"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line("found").alias("spans"))
