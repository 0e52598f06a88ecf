"""Secret scans by one deterministic automaton for all rules.

Rules are regular expressions over bytes. Their positions (Glushkov's automaton, no empty
moves) are read from right to left and made deterministic together by subset construction,
then minimised by partition refinement, over classes of bytes that no rule tells apart. One
pass of a text from its end to its beginning through that transition array marks, for all
rules at once, every place where a match of a rule begins. From the leftmost place on, the
rule's own small automaton walks to the longest end, and the rule goes on behind it; so each
rule's matches are leftmost, longest and do not overlap, and both passes are linear in the text.

A rule's length condition is looked at after its match is taken, so a match that is too short
still covers what it covers. Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; equal rows are scanned each for itself; any
bytes are scanned, valid UTF-8 or not, bytes of one character counting as one; further columns,
whatever their names, pass ``redacted`` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, text_of


@dataclass(frozen=True)
class Rule:
    """``head`` and ``value`` match one after the other; the value needs ``least`` bytes."""

    kind: str
    value: str
    least: int = 1
    head: str = ""


#: The kinds that the contract lists. A run of 32 hexadecimal digits is asked for in the
#: pattern: runs are maximal, so shorter ones hide nothing, and fewer places are marked.
BASE_RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url", r"[a-z][a-z+]*://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@"),
)
RULES = BASE_RULES + MORE_RULES


class Positions:
    """Byte positions of a set of expressions, and which may follow which.

    Read: literals, escapes, classes, groups, (?i:...), alternatives, ``* + ?`` and {m,n}.
    """

    def __init__(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, pattern: str) -> tuple[bool, set[int], set[int]]:
        """(matches nothing too, first positions, last positions) of the pattern."""
        self.text, self.at, self.fold = pattern, 0, False
        made = self._alternatives()()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced: {pattern[self.at :]}")
        return made

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    # Parts come as functions that make their positions anew at each call: {m,n} calls them often.
    def _alternatives(self) -> Callable:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())

        def make():
            made = [p() for p in parts]
            return any(m[0] for m in made), set().union(*(m[1] for m in made)), set().union(*(m[2] for m in made))

        return make

    def _join(self, a: tuple, b: tuple) -> tuple:
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def chain(self, parts: Iterable[tuple]) -> tuple[bool, set[int], set[int]]:
        made = (True, set(), set())
        for p in parts:
            made = self._join(made, p)
        return made

    def _sequence(self) -> Callable:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return lambda: self.chain([p() for p in parts])

    def _repeated(self, atom: Callable) -> Callable:
        c = self._peek()
        if c not in ("*", "+", "?", "{") or not c:
            return atom
        if c == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : stop].partition(",")
            low, most = int(low), (None if comma and not high else int(high or low))
            self.at = stop + 1
        else:
            low, most = int(c == "+"), (1 if c == "?" else None)
            self.at += 1

        def make():
            made = (True, set(), set())
            for _ in range(low - (most is None and low > 0)):
                made = self._join(made, atom())
            if most is None:
                loop = atom()
                self._join(loop, loop)
                return self._join(made, loop if low else (True, loop[1], loop[2]))
            for _ in range(most - low):
                made = self._join(made, (True, *atom()[1:]))
            return made

        return make

    def _atom(self) -> Callable:
        c = self._peek()
        if c == "(":
            self.at += 1
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            inner = self._alternatives()
            self.at, self.fold = self.at + 1, fold
            return inner
        if c == "[":
            found = self._class()
        elif c == ".":
            self.at += 1
            found = set(range(256)) - {10}
        else:
            found = {self._byte()}
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        found = frozenset(found)

        def make():
            self.sets.append(found)
            self.follow.append(set())
            p = {len(self.sets) - 1}
            return False, p, p

        return make

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c != "\\":
            return c.encode("ascii")[0]
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def _class(self) -> set[int]:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            found |= set(range(low, high + 1))
        self.at += 1
        return set(range(256)) - found if negated else found


@dataclass
class Automaton:
    """next[state * width + class] is the next state times width; marks[state] has a bit a label, and unmarked states come first."""

    classes: bytes
    width: int
    start: int
    next: list[int]
    marks: list[int] = field(repr=False)


def determinised(sets: list[frozenset[int]], follow: Sequence[set[int]], first: set[int], labels: list[set[int]], anchored: bool) -> Automaton:
    """The minimal automaton over subsets of positions; a state has label i if it holds a position of labels[i].

    ``first`` begins a match: only at the start if anchored, else at every byte.
    """
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    member = [frozenset(p for p, inside in enumerate(k) if inside) for k in kinds]
    begin = frozenset([-1])  # nothing read yet
    states: dict[frozenset, int] = {begin: 0}
    rows, todo = [], [begin]
    for state in todo:
        reach = set(first) if state == begin or not anchored else set()
        for p in state - begin:
            reach |= follow[p]
        row = []
        for m in member:
            to = frozenset(reach & m)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        rows.append(row)
    table = np.array(rows)
    marks = np.array([sum(1 << i for i, own in enumerate(labels) if own & s) for s in todo])
    # Moore's refinement: states stay together while their marks and successors' blocks agree
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    chosen = np.unique(block, return_index=True)[1]
    chosen = chosen[np.argsort(marks[chosen] > 0, kind="stable")]  # marked states last: one comparison tells them
    place = np.empty(len(chosen), np.int64)
    place[block[chosen]] = np.arange(len(chosen))
    width = len(member)
    states = [i * width for i in range(len(chosen))]  # one number object a state, which the processor's cache holds
    to = [states[i] for i in place[block[table[chosen]]].ravel().tolist()]
    return Automaton(classes, width, states[place[block[0]]], to, marks[chosen].tolist())


class Scanner:
    """All rules in transition arrays; small enough to travel with a task."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        p, firsts, lasts = Positions(), [], []
        self.walks = []
        for r in self.rules:
            begin, end = self._ends(p, r)[:2]
            firsts.append(begin)
            lasts.append(end)
            own = Positions()
            begin, end, head, headless = self._ends(own, r)
            walk = determinised(own.sets, own.follow, begin, [end, head], True)
            self.walks.append((walk, headless))
        back: list[set[int]] = [set() for _ in p.sets]
        for a, after in enumerate(p.follow):
            for b in after:
                back[b].add(a)
        self.marker = determinised(p.sets, back, set().union(*lasts), firsts, False)

    @staticmethod
    def _ends(p: Positions, r: Rule) -> tuple[set[int], set[int], set[int], bool]:
        """First and last positions of the rule, last ones of its head, and whether the head may be empty."""
        empty, head_first, head_last = p.add(r.head)
        value = p.add(r.value)
        whole = p.chain([(empty, head_first, head_last), value])
        if whole[0]:
            raise ValueError(f"{r.kind} matches the empty text")
        return whole[1], whole[2], head_last, empty

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, mask of rules) of every place where some rule's match begins, from the last to the first."""
        m = self.marker
        step, state, marked = m.next, m.start, m.marks.count(0) * m.width
        found, last = [], len(data) - 1
        for i, c in enumerate(data[::-1].translate(m.classes)):
            state = step[state + c]
            if state >= marked:
                found.append((last - i, m.marks[state // m.width]))
        return found

    def _walk(self, k: int, data: bytes, at: int) -> tuple[int, int]:
        """Longest end of the rule's match from ``at`` on, and where its value begins."""
        walk, headless = self.walks[k]
        step, width, classes = walk.next, walk.width, walk.classes
        state, end, value, i = walk.start, at, at if headless else -1, at
        dead = self._dead(walk)
        while i < len(data):
            state = step[state + classes[data[i]]]
            if state == dead:
                break
            i += 1
            mark = walk.marks[state // width]
            if mark & 2:
                value = i
            if mark & 1:
                end = i
        return end, value

    @staticmethod
    def _dead(walk: Automaton) -> int:
        """The state that nothing leaves and nothing marks, or -1."""
        for s, mark in enumerate(walk.marks):
            if not mark and all(t == s * walk.width for t in walk.next[s * walk.width : (s + 1) * walk.width]):
                return s * walk.width
        return -1

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of all matches long enough, by start and rule."""
        out, free = [], [0] * len(self.rules)
        for at, mask in reversed(self.starts(data)):
            for k, r in enumerate(self.rules):
                if mask >> k & 1 and at >= free[k]:
                    free[k], value = self._walk(k, data, at)
                    if free[k] - value >= r.least:
                        out.append((at, k, free[k]))
        return out


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


SPANS = "array<struct<kind string, start bigint, end bigint>>"


def spans_of(text: Column, scanner: Scanner) -> Column:
    """Array of (kind, start, end), by start, then in the order of the rules."""
    kinds = [r.kind for r in scanner.rules]
    row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        found = [_code_points(t, scanner.spans(t)) for t in texts.to_pylist()]
        flat = [s for own in found for s in own]
        arrays = [pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())]
        ends = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=list(row)))

    return scan(text.cast("binary"))


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every row of docs."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"], spans_of(text_of(docs), Scanner(rules)).alias("spans"))


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every secret in the text replaced by its kind in brackets; overlapping ones by the first's."""
    ship(docs.sparkSession)
    scanner = Scanner(rules)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            parts, at, end = [], 0, 0
            for a, k, b in scanner.spans(t) if t else ():
                if a >= end:
                    parts += [t[at:a], f"[{scanner.rules[k].kind}]".encode()]
                at = end = max(end, b)
            out.append(t if t is None else b"".join([*parts, t[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    text = redact(docs["text"].cast("binary"))
    return docs.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_kind(i: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind: the texts between matches and the matches add up to their places."""
    return rf"""
  SELECT doc_id, rid, {i} AS k, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS j, unnest(m) AS hit,
         unnest(list_transform(range(1, len(m) + 1), lambda j: list_sum(list_transform(p[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: len(x))), 0))) AS a,
         {keep} AS least
  FROM (SELECT doc_id, rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM texts)
  WHERE len(m) > 0"""


_SQL_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "8"),
    ("access", "AKIA[A-Z0-9]+", "16"),
    ("hex", "[0-9a-f]+", "32"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "1"),
    ("github", "gh[opsur]_[A-Za-z0-9]+", "40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "15"),
    ("google", "AIza[A-Za-z0-9_-]+", "39"),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", "24"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "1"),
    ("url", r"[a-z][a-z+]*://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@", "1"),
]

OP11_SQL = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_kind(i, *x) for i, x in enumerate(_SQL_KINDS))}
), kept AS (
  SELECT rid, k, kind, a::BIGINT AS a, (a + len(hit))::BIGINT AS b FROM found
  WHERE len(CASE WHEN k = 0 THEN regexp_extract(hit, '{_SQL_KINDS[0][1]}', 2) ELSE hit END) >= least
), listed AS (
  SELECT rid, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed ON texts.rid = listed.rid
"""
