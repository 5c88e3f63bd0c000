"""The textual query language.

    vmatch (a{tag:1-3})-[1..3]s->(b), (b)<-(c{id:5})-[2]-(d) return [count of] a, b.community;

Vertices may carry ``{id:n}`` or ``{tag:low-high}``; an edge is ``->``, ``<-`` or
``-``, with a length ``[n]``, ``[low..high]``, ``[..high]`` (from 1) or ``[]`` (1), and
``s`` behind it for shortest paths. A variable named again is the same vertex; it may have
its condition at any one of these places, not at two.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph
from hopweave.plans.pattern import Compiled, Pattern
from hopweave.schema import Direction

_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>->|<-|\.\.|[-(){}\[\],.:;]))")


@dataclass
class Query:
    pattern: Pattern
    returns: list[tuple[str, str | None]]
    only_count: bool


class _Parser:
    def __init__(self, text: str, label: str, kind: str, tag: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].strip()[0]!r} at {at}")
            self.tokens.append(m[m.lastgroup])
            at = m.end()
        self.i, self.label, self.kind, self.tag = 0, label, kind, tag
        self.pattern = Pattern()

    def peek(self) -> str:
        return self.tokens[self.i] if self.i < len(self.tokens) else ""

    def take(self, *want: str) -> str:
        t = self.peek()
        if want and t not in want:
            raise ValueError(f"{' or '.join(want)} expected, not {t or 'the end'!r}")
        self.i += 1
        return t

    def number(self) -> int:
        t = self.take()
        if not t.isdigit():
            raise ValueError(f"a number expected, not {t!r}")
        return int(t)

    def name(self) -> str:
        t = self.take()
        if not re.fullmatch(r"[A-Za-z_]\w*", t):
            raise ValueError(f"a name expected, not {t!r}")
        return t

    def vertex(self) -> str:
        self.take("(")
        name = self.name()
        v = self.pattern.get_vertex_or_create(name, self.label)
        if self.peek() == "{":
            if v.conditions:
                raise ValueError(f"{name} has a condition already")
            self.take()
            what = self.take("id", "tag")
            self.take(":")
            low = self.number()
            if what == "tag":
                self.take("-")
                v.where(F.col(self.tag).between(low, self.number()))
            else:
                v.where(F.col("id") == low)
            self.take("}")
        self.take(")")
        return name

    def length(self) -> tuple[int, int, str]:
        """Behind an opening sign: (low, high, path)."""
        if self.peek() != "[":
            return 1, 1, "any"
        self.take()
        low = high = 1
        if self.peek() == "..":
            self.take()
            high = self.number()
        elif self.peek() != "]":
            low = high = self.number()
            if self.peek() == "..":
                self.take()
                high = self.number()
        self.take("]")
        if self.peek() == "s":
            self.take()
            return low, high, "shortest"
        return low, high, "any"

    def edge(self) -> tuple[int, int, str, Direction]:
        sign = self.take("->", "<-", "-")
        if sign == "->":
            return 1, 1, "any", Direction.FORWARD
        bare = self.peek() == "("
        low, high, path = self.length()
        if sign == "<-":
            if not bare:
                self.take("-")
            return low, high, path, Direction.BACKWARD
        if bare:
            return low, high, path, Direction.BOTH
        end = self.take("->", "-")
        return low, high, path, Direction.FORWARD if end == "->" else Direction.BOTH

    def parse(self) -> Query:
        self.take("vmatch")
        while True:
            last = self.vertex()
            while self.peek() in ("->", "<-", "-"):
                low, high, path, direction = self.edge()
                nxt = self.vertex()
                self.pattern.connect(last, nxt, self.kind, low, high, path, direction)
                last = nxt
            if self.take(",", "return") == "return":
                break
        only = self.peek() == "count" and self.tokens[self.i + 1 : self.i + 2] == ["of"]
        if only:
            self.i += 2
        returns = []
        while True:
            name, prop = self.name(), None
            if name not in self.pattern.vertices:
                raise ValueError(f"{name} is not in the pattern")
            if self.peek() == ".":
                self.take()
                prop = self.name()
            returns.append((name, prop))
            if self.take(",", ";") == ";":
                break
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} behind the query")
        return Query(self.pattern, returns, only)


def parse(text: str, label: str = "Person", kind: str = "knows", tag: str = "community") -> Query:
    return _Parser(text, label, kind, tag).parse()


def query(graph: PropertyGraph, text: str, order: list[str] | None = None, **names: str) -> DataFrame:
    """Run a query; ``order`` fixes the variable order, else a heuristic picks it."""
    q = parse(text, **names)
    plan = Compiled(graph, q.pattern)
    return plan.count(order) if q.only_count else plan.project(plan.rows(order), q.returns)
