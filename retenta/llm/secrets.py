"""Secret scans with one combined deterministic automaton.

Rules are regular expressions over bytes (a small syntax: literals, classes,
groups, alternation, ``? * + {m,n}``). Thompson's construction gives one
automaton for all rules, subset construction makes it deterministic, Moore's
partition refinement minimises it, and bytes that no state tells apart share a
column. The unanchored automaton reads each text once for all rules; texts in
which nothing is accepted (nearly all) are done. In the others, an accept at
byte i says that a match of its rules ends there; the rule's reversed automaton
finds the leftmost start from i, its anchored automaton the longest end.

That start is right for rules whose matches don't begin inside the shortest
match of an earlier start, which holds for all rules below: a match that starts
earlier is accepted no later.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, head, tail, whether letters of the head match in either case, and
# the least length of tail or match. Lengths are checked on the whole match, after it has
# been taken: counters for them would multiply the automaton's states.
# The first three are the base rules; the others are well-known token formats.
RULES = [
    ("assign", """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?""", "[A-Za-z0-9+/_.=-]+", True, ("tail", 12)),
    ("access", "AKIA", "[A-Z0-9]+", False, ("match", 18)),
    ("hex", "", "[0-9a-f]{16,}", False, ("match", 16)),
    ("github", "gh[pousr]_", "[A-Za-z0-9]+", False, ("tail", 36)),
    ("google", "AIza", "[A-Za-z0-9_-]+", False, ("tail", 35)),
    ("slack", "xox[abprs]-", "[A-Za-z0-9-]+", False, ("tail", 10)),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "", False, ("match", 0)),
]
BASE = ["assign", "access", "hex"]


class _Parser:
    """Pattern to a tree: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most)."""

    def __init__(self, pattern: str, either_case: bool):
        self.p, self.i, self.fold = pattern, 0, either_case

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.one()))
        return ("cat", parts)

    def repeated(self, part):
        c = self.peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return ("rep", part, int(c == "+"), 1 if c == "?" else None)
        if c == "{":
            end = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1:end].partition(",")
            self.i = end + 1
            return ("rep", part, int(low), (int(high) if high else None) if comma else int(low))
        return part

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2:self.i], 16)
        return ord(c)

    def one(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            part = self.alternatives()
            self.i += 1
            return part
        if c == "[":
            self.i += 1
            found: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    found.update(range(low, self.char() + 1))
                else:
                    found.add(low)
            self.i += 1
            return self.folded(found)
        return self.folded({self.char()})

    def folded(self, found: set[int]):
        if self.fold:
            found = found | {x ^ 32 for x in found if chr(x).isalpha() and x < 128}
        return ("set", frozenset(found))


def _mirrored(tree):
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", _mirrored(tree[1]), *tree[2:])
    parts = [_mirrored(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, tree, start: int) -> int:
        """Builds ``tree`` from ``start``; the state in which it ends."""
        kind = tree[0]
        if kind == "set":
            mid, end = self.state(), self.state()
            self.empty[start].append(mid)
            self.on[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """Minimal automaton. ``columns``: byte to column (bytes.translate); ``move[state][column]``; ``accepts[state]``: rules."""

    def __init__(self, trees: list, unanchored: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            first = nfa.state()
            nfa.empty[start].append(first)
            ends[nfa.add(tree, first)] = k
        classes: dict[tuple, int] = {}
        sets = list(dict.fromkeys(x[0] for x in nfa.on if x))
        self.columns = bytes(classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256))
        sample = {c: b for b, c in reversed(list(enumerate(self.columns)))}
        root = nfa.closed([start])
        number, todo, move = {root: 0}, [root], []
        while todo:                                             # subset construction
            now, nxt = [], []
            for at in todo:
                row = []
                for c in range(len(classes)):
                    to = {x[1] for x in (nfa.on[s] for s in at) if x and sample[c] in x[0]}
                    target = nfa.closed(to) | (root if unanchored else frozenset())
                    if target not in number:
                        number[target] = len(number)
                        nxt.append(target)
                    row.append(number[target])
                now.append(row)
            move += now
            todo = nxt
        accepts = [frozenset(ends[s] for s in at if s in ends) for at in number]
        block = [sorted(map(sorted, set(accepts))).index(sorted(a)) for a in accepts]
        while True:                                             # partition refinement
            found: dict[tuple, int] = {}
            finer = [found.setdefault((block[i], *(block[t] for t in row)), len(found)) for i, row in enumerate(move)]
            if len(found) == len(set(block)):
                break
            block = finer
        firsts = {b: i for i, b in reversed(list(enumerate(block)))}
        order = sorted(firsts, key=lambda b: (b != block[0], b))   # the start is state 0
        new = {b: n for n, b in enumerate(order)}
        self.move = [[new[block[t]] for t in move[firsts[b]]] for b in order]
        self.accepts = [accepts[firsts[b]] for b in order]
        self.dead = next((i for i, row in enumerate(self.move) if set(row) == {i} and not self.accepts[i]), None)
        # Rows that point at rows: a step is one index. Accepting steps of ``sticky`` lead to ``hit`` for good.
        self.hit: list = []
        rows = [[] for _ in self.move]
        for i, to in enumerate(self.move):
            rows[i][:] = [self.hit if self.accepts[t] else rows[t] for t in to]
        self.hit[:] = [self.hit] * len(classes)
        self.first = rows[0]

    def found(self, data: bytes) -> bool:
        """Whether any rule matches anywhere."""
        row = self.first
        for c in data.translate(self.columns):
            row = row[c]
        return row is self.hit

    def longest(self, data: bytes, start: int, step: int = 1, stop: int | None = None) -> int | None:
        """From ``start``, forwards or backwards, the furthest place at which the automaton accepts."""
        state, last, stop = 0, None, (len(data) if step > 0 else 0) if stop is None else stop
        at = start
        while at != stop:
            state = self.move[state][self.columns[data[at if step > 0 else at - 1]]]
            at += step
            if state == self.dead:
                break
            if self.accepts[state]:
                last = at
        return last


class Scanner:
    def __init__(self, rules=tuple(RULES)):
        self.names = [r[0] for r in rules]
        self.least = [r[4] for r in rules]
        heads = [_Parser(head, fold).alternatives() for _, head, _, fold, _ in rules]
        trees = [("cat", [h, _Parser(tail, False).alternatives()]) for h, (_, _, tail, _, _) in zip(heads, rules)]
        self.all = Automaton(trees, unanchored=True)
        self.ahead = [Automaton([t]) for t in trees]
        self.back = [Automaton([_mirrored(t)]) for t in trees]
        self.head = [Automaton([h]) for h in heads]

    def kept(self, k: int, data: bytes, start: int, end: int) -> bool:
        part, least = self.least[k]
        return end - (self.head[k].longest(data, start) if part == "tail" else start) >= least

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind in the order of the rules."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not self.all.found(data):
            return []
        found, free = [], [0] * len(self.names)
        state, move, accepts = 0, self.all.move, self.all.accepts
        for i, c in enumerate(data.translate(self.all.columns), 1):
            state = move[state][c]
            for k in accepts[state]:
                if i > free[k] and (start := self.back[k].longest(data, i, -1, free[k])) is not None:
                    free[k] = self.ahead[k].longest(data, start)
                    if self.kept(k, data, start, free[k]):
                        found.append((start, k, free[k]))
        ascii_only = len(data) == len(text)
        points = (lambda x: x) if ascii_only else (lambda x: len(data[:x].decode("utf-8", "surrogatepass")))
        return [(self.names[k], points(s), points(e)) for s, k, e in sorted(found)]


@lru_cache(1)
def scanner() -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, matches array<struct<kind, start, end>>.

    Whole texts; null and empty texts have no matches. Null ids and repeated rows
    pass through; other columns are ignored. Empty input, empty result.
    """
    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def matches(texts: pd.Series) -> pd.Series:
        spans = scanner().spans
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in texts])

    return docs.select("doc_id", matches("text").alias("matches"))


def digest(matches: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from the rows of ``scan``."""
    def listed(x):
        return F.array_join(F.transform(x, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")

    base = F.filter("matches", lambda m: m["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("matches", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, BASE)
    return matches.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                          listed(F.col("matches")).alias("spans"))
