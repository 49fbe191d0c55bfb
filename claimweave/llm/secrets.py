"""Operator 3: secrets in whole texts, found by one automaton for all rules in one pass over the bytes.

A rule is a head and a tail pattern (ASCII, in the syntax of ``re``; literals, classes, groups,
alternatives and repeats). The reversed patterns of all rules make one nondeterministic automaton that
restarts at every byte; subset construction and minimisation turn it into one transition array. Run
from the end of a text to its beginning, it marks every position where a match of some rule starts.
From the leftmost start on, that rule's own small automata then measure the longest head and tail;
the next match of the rule begins at or after its end. Matches with too short a tail are dropped
(after they have taken their place). Spans are in code points, ends exclusive.

Null and empty texts have no span. Very long texts are scanned in time and memory proportional to their
length. Spans of different kinds may overlap; of equal starts the order of the rules counts. Repeated rows
get equal answers; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.batches import text_slices, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match is head then tail, its tail ``least`` bytes long or longer."""

    kind: str
    head: str
    tail: str
    least: int
    any_case: bool = False  # of the letters of the head


#: The base rules, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    Rule("hex", r"", r"[0-9a-f]+", 16),
)
#: Published shapes of further credentials.
MORE_RULES = (
    Rule("github", r"gh[opsru]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abeprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]+", 16),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("key_block", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY", r"-----", 5),
)
RULES = BASE_RULES + MORE_RULES


class Nfa:
    """Thompson construction from a parsed pattern; edges go by byte sets or are empty."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, parsed, start: int, any_case: bool, backward: bool) -> int:
        """Append a sequence of parsed items after ``start``; the state where it ends."""
        for op, value in reversed(list(parsed)) if backward else parsed:
            if op in (sre.LITERAL, sre.IN):
                chars = {value} if op is sre.LITERAL else set().union(*(range(v[0], v[1] + 1) if k is sre.RANGE else {v} for k, v in value))
                if any_case:
                    chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
                end = self.state()
                self.edges[start].append((frozenset(chars), end))
                start = end
            elif op is sre.SUBPATTERN:
                start = self.add(value[3], start, any_case, backward)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in value[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.add(branch, first, any_case, backward)].append(end)
                start = end
            elif op is sre.MAX_REPEAT:
                low, high, item = value
                for _ in range(low):
                    start = self.add(item, start, any_case, backward)
                end = self.state()
                self.empty[start].append(end)
                if high is sre.MAXREPEAT:
                    first = self.state()
                    self.empty[start].append(first)
                    last = self.add(item, first, any_case, backward)
                    self.empty[last] += [first, end]
                else:
                    for _ in range(high - low):
                        start = self.add(item, start, any_case, backward)
                        self.empty[start].append(end)
                start = end
            else:
                raise ValueError(f"a rule may not use {op}")
        return start

    def closure(self, states) -> frozenset[int]:
        seen, open_ = set(states), list(states)
        while open_:
            for t in self.empty[open_.pop()]:
                if t not in seen:
                    seen.add(t)
                    open_.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """transitions[state * 256 + byte] is the next state times 256; accepts holds a bit for each rule."""

    transitions: list[int]
    accepts: list[int]
    dead: int  # the state without exit (times 256), -1 if there is none


def determine(nfa: Nfa, starts: list[int], ends: dict[int, int], restart: bool) -> Dfa:
    """Subset construction, then minimisation by refining classes of states until they are stable."""
    first = nfa.closure(starts)
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        moves: list[set[int]] = [set() for _ in range(256)]
        for s in subset:
            for chars, t in nfa.edges[s]:
                for c in chars:
                    moves[c].add(t)
        row, seen = [], {}
        for c in range(256):
            key = frozenset(moves[c])
            if key not in seen:
                target = nfa.closure(key | first) if restart else nfa.closure(key)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                seen[key] = number[target]
            row.append(seen[key])
        rows.append(row)
    table = np.array(rows)
    marks = np.array([sum(1 << r for r in {ends[s] for s in subset if s in ends}) for subset in order])
    _, block = np.unique(marks, return_inverse=True)
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    keep = np.unique(block, return_index=True)[1]
    rank = np.argsort(np.argsort(block[keep] != block[0], kind="stable"), kind="stable")  # the start state is state 0
    place = np.empty(len(keep), dtype=int)
    place[rank] = np.arange(len(keep))
    merged = rank[block[table[keep[place]]]]
    marks = marks[keep[place]]
    stuck = np.flatnonzero((merged == np.arange(len(merged))[:, None]).all(axis=1) & (marks == 0))
    return Dfa((merged * 256).ravel().tolist(), marks.tolist(), int(stuck[0]) * 256 if len(stuck) else -1)


def _parsed(pattern: str):
    return list(sre_parser.parse(pattern))


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, list[tuple[Dfa, Dfa]]]:
    """The automaton of all rules read backward, and each rule's head and tail read forward."""
    nfa, starts, ends = Nfa(), [], {}
    for r, rule in enumerate(rules):
        s = nfa.state()
        starts.append(s)
        tail = _parsed(rule.tail)
        op, value = tail[0]
        if len(tail) == 1 and op is sre.MAX_REPEAT and not rule.head:  # a bare run starts where it is long enough
            tail = [(op, (rule.least, value[1], value[2]))]
        ends[nfa.add(_parsed(rule.head), nfa.add(tail, s, False, True), rule.any_case, True)] = r
    whole = determine(nfa, starts, ends, restart=True)
    parts = []
    for rule in rules:
        pair = []
        for pattern, any_case in ((rule.head, rule.any_case), (rule.tail, False)):
            own = Nfa()
            s = own.state()
            pair.append(determine(own, [s], {own.add(_parsed(pattern), s, any_case, False): 0}, restart=False))
        parts.append(tuple(pair))
    return whole, parts


def _longest(dfa: Dfa, data: bytes, at: int) -> int | None:
    """Where the longest match that begins at ``at`` ends."""
    state, end = 0, at if dfa.accepts[0] else None
    transitions, accepts = dfa.transitions, dfa.accepts
    for i in range(at, len(data)):
        state = transitions[state + data[i]]
        if accepts[state >> 8]:
            end = i + 1
        elif state == dfa.dead:
            break
    return end


def find(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of every match, by start, then rule."""
    whole, parts = compiled(rules)
    transitions, accepts, state = whole.transitions, whole.accepts, 0
    marking = {s << 8 for s, x in enumerate(accepts) if x}
    marks = []
    for i, c in enumerate(reversed(data)):
        state = transitions[state + c]
        if state in marking:
            marks.append((i, state))
    if not marks:
        return []
    size, found, free = len(data) - 1, [], [0] * len(rules)
    for i, state in reversed(marks):
        at, which = size - i, accepts[state >> 8]
        for r in range(len(rules)):
            if which >> r & 1 and at >= free[r]:
                middle = _longest(parts[r][0], data, at)
                end = None if middle is None else _longest(parts[r][1], data, middle)
                if end is not None:
                    free[r] = end
                    if end - middle >= rules[r].least:
                        found.append((at, r, end))
    return sorted(found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): all matches of each text by start, then in the order of the rules."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_slices(batches):
            out = []
            for text in texts_of(batch).to_pylist():
                data = text.encode()
                spans = find(data, rules)
                if spans and len(data) != len(text):
                    spans = [(len(data[:a].decode()), r, len(data[:b].decode())) for a, r, b in spans]
                out.append([{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every found secret replaced by its kind in angle brackets; overlapping ones as one, named by the first."""

    def run(batches):
        for batch in text_slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                data, parts, done = (text or "").encode(), [], 0
                for a, r, b in find(data, rules):
                    if a >= done:
                        parts += [data[done:a], f"<{rules[r].kind}>".encode()]
                    done = max(done, b)
                out.append(text if not parts else (b"".join(parts) + data[done:]).decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(counted(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


