"""Graph patterns and their compilation to DataFrame operations.

A pattern is a set of labelled, filtered vertices and variable-length edges between
them. Every edge becomes a table of (a_id, b_id) pairs, expanded from its smaller end and
kept for both orientations. ``rows`` binds one variable after another by
multi-way intersection. ``count`` first takes leaf vertices off, replacing each by
the number of its matches, so paths and tails are never listed; of what is left, vertices
whose edges are all walked are numbers of ways too, so cycles are not listed either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph
from hopweave.operators.expand import expand
from hopweave.operators.joins import mintersect
from hopweave.schema import Direction, Step
from hopweave.storage import stored

_TURNED = {Direction.FORWARD: Direction.BACKWARD, Direction.BACKWARD: Direction.FORWARD}


@dataclass
class Vertex:
    name: str
    label: str
    conditions: list[Column] = field(default_factory=list)
    pattern: Pattern | None = None

    def where(self, condition: Column) -> Vertex:
        self.conditions.append(condition)
        return self

    def vexpand_any(self, other: Vertex, kind: str, k_min: int = 1, k_max: int = 1, direction: Direction = Direction.BOTH) -> Vertex:
        self.pattern.connect(self.name, other.name, kind, k_min, k_max, "any", direction)
        return self

    def vexpand_shortest(self, other: Vertex, kind: str, k_min: int = 1, k_max: int = 1, direction: Direction = Direction.BOTH) -> Vertex:
        self.pattern.connect(self.name, other.name, kind, k_min, k_max, "shortest", direction)
        return self


@dataclass(frozen=True)
class Edge:
    a: str
    b: str
    kind: str
    k_min: int = 1
    k_max: int = 1
    path: str = "any"
    direction: Direction = Direction.BOTH


class Pattern:
    def __init__(self) -> None:
        self.vertices: dict[str, Vertex] = {}
        self.edges: list[Edge] = []

    def create_vertex(self, name: str, label: str, *conditions: Column) -> Vertex:
        if name in self.vertices:
            raise ValueError(f"vertex {name} exists")
        self.vertices[name] = Vertex(name, label, list(conditions), self)
        return self.vertices[name]

    def get_vertex(self, name: str) -> Vertex | None:
        return self.vertices.get(name)

    def get_vertex_or_create(self, name: str, label: str) -> Vertex:
        return self.vertices.get(name) or self.create_vertex(name, label)

    def connect(self, a: str, b: str, kind: str, k_min: int = 1, k_max: int = 1, path: str = "any", direction: Direction = Direction.BOTH) -> Pattern:
        if a == b or any({e.a, e.b} == {a, b} for e in self.edges):
            raise ValueError(f"one edge at most between two vertices: {a}, {b}")
        self.edges.append(Edge(a, b, kind, k_min, k_max, path, direction))
        return self

    def degree(self, name: str, edges: list[Edge]) -> int:
        return sum(name in (e.a, e.b) for e in edges)

    def connected(self, order: list[str]) -> bool:
        """Whether each vertex after the first has an edge to an earlier one."""
        return all(any({v, u} == {e.a, e.b} for e in self.edges for u in order[:i]) for i, v in enumerate(order) if i)

    def orders(self) -> Iterator[list[str]]:
        """All variable orders that a left-deep plan can take."""
        for p in permutations(self.vertices):
            if self.connected(list(p)):
                yield list(p)

    def dot(self) -> str:
        """The pattern in the DOT language."""
        out = ["graph pattern {"]
        out += [f'  {v.name} [label="{v.name}:{v.label}"];' for v in self.vertices.values()]
        out += [f'  {e.a} -- {e.b} [label="{e.kind} {e.k_min}..{e.k_max} {e.path} {e.direction.value}"];' for e in self.edges]
        return "\n".join([*out, "}"])


class Compiled:
    """A pattern over one graph. Tables are made once and shared by all plans of it."""

    def __init__(self, graph: PropertyGraph, pattern: Pattern, strategy: str = "auto"):
        if not pattern.vertices:
            raise ValueError("a pattern has a vertex")
        self.graph, self.pattern, self.strategy = graph, pattern, strategy
        self._ids: dict[str, DataFrame] = {}
        self._sizes: dict[str, int] = {}
        self._pairs: dict[Edge, DataFrame] = {}
        self._steps: dict[Step, DataFrame] = {}
        self._through: dict[tuple, DataFrame] = {}

    def ids(self, name: str) -> DataFrame:
        """(name_id) of a vertex's matches by its own conditions."""
        if name not in self._ids:
            v = self.pattern.vertices[name]
            self._ids[name] = self.graph.scan(v.label, None, v.conditions).select(F.col("id").alias(f"{name}_id")).distinct()
        return self._ids[name]

    def size(self, name: str) -> int:
        if name not in self._sizes:
            self._sizes[name] = self.ids(name).count()
        return self._sizes[name]

    def pairs(self, e: Edge) -> DataFrame:
        """Distinct (a_id, b_id), expanded from the end with fewer vertices."""
        if e not in self._pairs:
            a, b, d = e.a, e.b, e.direction
            if self.size(b) < self.size(a):
                a, b, d = b, a, _TURNED.get(d, d)
            va, vb = self.pattern.vertices[a], self.pattern.vertices[b]
            label = Step(va.label, e.kind, vb.label, d)
            if e.k_max > 1 and label not in self._steps:
                self._steps[label] = stored(self.graph.step(label), "edges")
            step = self._steps[label] if label in self._steps else self.graph.step(label)
            # only the last vertex is filtered: those between may be any
            found = expand(self.ids(a), f"{a}_id", f"{b}_id", step, e.k_min, e.k_max, e.path, strategy=self.strategy, distinct_starts=True, targets=self.ids(b))
            self._pairs[e] = stored(found, "pairs")
        return self._pairs[e]

    def default_order(self) -> list[str]:
        """Start at the smallest vertex set, go on with the vertex most bound by edges, then the smallest."""
        left = dict(self.pattern.vertices)
        order: list[str] = []
        while left:
            bound = {v: sum({v, u} == {e.a, e.b} for e in self.pattern.edges for u in order) for v in left}
            nxt = min(left, key=lambda v: (-bound[v], self.size(v), v))
            if order and not bound[nxt]:
                raise ValueError("the pattern is not connected")
            order.append(nxt)
            del left[nxt]
        return order

    def rows(self, order: list[str] | None = None) -> DataFrame:
        """All matches, one column ``<name>_id`` a vertex."""
        order = order or self.default_order()
        if sorted(order) != sorted(self.pattern.vertices) or not self.pattern.connected(order):
            raise ValueError(f"not an order of this pattern: {order}")
        return self._bind(order, self.pattern.edges).select(*[f"{v}_id" for v in self.pattern.vertices])

    def _bind(self, order: list[str], edges: list[Edge]) -> DataFrame:
        if len(order) == 1:
            return self.ids(order[0])
        out = None
        for i, v in enumerate(order[1:], 1):
            tables = [self.pairs(e) for u in order[:i] for e in edges if {u, v} == {e.a, e.b}]
            out = tables[0] if out is None else mintersect(out, f"{v}_id", tables)
        return out

    def count(self, order: list[str] | None = None) -> DataFrame:
        """The number of matches, as ``count``."""
        left, weights = dict(self.pattern.vertices), {v: [] for v in self.pattern.vertices}
        edges = list(self.pattern.edges)
        while leaf := next((v for v in left if len(left) > 1 and self.pattern.degree(v, edges) == 1), None):
            edge = next(e for e in edges if leaf in (e.a, e.b))
            other = edge.b if edge.a == leaf else edge.a
            rows, w = self._weighted(self.pairs(edge), leaf, weights[leaf])
            weights[other].append(rows.groupBy(f"{other}_id").agg(F.sum(w).alias("w")))
            edges.remove(edge)
            del left[leaf]
        core = [v for v in order or self.default_order() if v in left]
        if not self._connected(core, edges):
            core = self._reordered(core, edges)
        return self._counted(core, edges, weights)

    def count_in(self, order: list[str]) -> DataFrame:
        """``count`` with every vertex bound in this order, leaves too."""
        if sorted(order) != sorted(self.pattern.vertices) or not self.pattern.connected(order):
            raise ValueError(f"not an order of this pattern: {order}")
        return self._counted(order, self.pattern.edges, {v: [] for v in order})

    def _counted(self, order: list[str], edges: list[Edge], weights: dict[str, list[DataFrame]]) -> DataFrame:
        """Binds one vertex after another. One whose edges are all walked becomes a number of ways; if
        one has, the last vertex is not listed but counted for each pair of its neighbours."""
        tables = {v: [self.pairs(e) for u in order[:i] for e in edges if {u, v} == {e.a, e.b}] for i, v in enumerate(order)}
        live, gone, one = [], False, F.lit(1).cast("long")
        out = self.ids(order[0]) if len(order) == 1 else None
        for i, v in enumerate(order):
            if gone and i == len(order) - 1 and len(tables[v]) == 2:
                return self._total(out.join(self._ways(edges, v, weights[v]), live).select((F.col("_n") * F.col("_m")).alias("_n")))
            if i == 2 and len(order) > 3 and (middle := self._middle(order[:3], edges)):
                ends = [u for u in order[:3] if u != middle]
                out, live, gone = self._ways(edges, middle, weights[middle]).withColumnRenamed("_m", "_n"), [f"{u}_id" for u in ends], True
                for u in ends:
                    out, w = self._weighted(out, u, weights[u])
                    out = out.withColumn("_n", w * F.col("_n")).select(*live, "_n")
                continue
            if i == 1:
                first, w = self._weighted(tables[v][0], order[0], weights[order[0]])
                out = first.withColumn("_n", w)
            elif i:
                out = mintersect(out, f"{v}_id", tables[v])
            elif out is None:
                live.append(f"{v}_id")
                continue
            out, w = self._weighted(out, v, weights[v])
            out = out.withColumn("_n", w * F.col("_n") if i else w)
            live.append(f"{v}_id")
            later = set(order[i + 1 :])
            keep = [f"{u}_id" for u in order[: i + 1] if f"{u}_id" in live and any({u, x} == {e.a, e.b} for e in edges for x in later)]
            if later and len(keep) < len(live):
                out, live, gone = out.groupBy(*keep).agg(F.sum("_n").alias("_n")), keep, True
            else:
                out = out.select(*live, "_n")
        return self._total(out)

    @staticmethod
    def _middle(three: list[str], edges: list[Edge]) -> str | None:
        """The middle of a path of three vertices, if it has no other edges."""
        if sum({e.a, e.b} <= set(three) for e in edges) != 2:
            return None
        of = {v: [e for e in edges if v in (e.a, e.b)] for v in three}
        return next((v for v in three if len(of[v]) == 2 and all({e.a, e.b} <= set(three) for e in of[v])), None)

    def _ways(self, edges: list[Edge], v: str, weights: list[DataFrame]) -> DataFrame:
        """(u_id, w_id, _m): in how many ways ``v`` joins its two neighbours; made once for all plans."""
        mine = [e for e in edges if v in (e.a, e.b)]
        key = (v, tuple(mine), len(weights))
        if key not in self._through:
            rows, w = self._weighted(self.pairs(mine[0]), v, weights)
            both = rows.withColumn("_m", w).join(self.pairs(mine[1]), f"{v}_id")
            ends = [f"{e.b if e.a == v else e.a}_id" for e in mine]
            self._through[key] = stored(both.groupBy(*ends).agg(F.sum("_m").alias("_m")), "ways")
        return self._through[key]

    @staticmethod
    def _total(rows: DataFrame) -> DataFrame:
        return rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("count"))

    @staticmethod
    def _weighted(rows: DataFrame, v: str, weights: list[DataFrame]) -> tuple[DataFrame, Column]:
        total = F.lit(1).cast("long")
        for i, w in enumerate(weights):
            name = f"_w_{v}_{i}"
            rows = rows.join(w.withColumnRenamed("w", name), f"{v}_id")
            total = total * F.col(name)
        return rows, total

    @staticmethod
    def _connected(order: list[str], edges: list[Edge]) -> bool:
        return all(any({v, u} == {e.a, e.b} for e in edges for u in order[:i]) for i, v in enumerate(order) if i)

    def _reordered(self, core: list[str], edges: list[Edge]) -> list[str]:
        return next(list(p) for p in permutations(core) if self._connected(list(p), edges))

    def project(self, rows: DataFrame, returns: list[tuple[str, str | None]]) -> DataFrame:
        """Properties of bound vertices; without one, the id. Columns are ``<name>_<property>``."""
        out, cols = rows, []
        for name, prop in returns:
            prop = prop or "id"
            col = f"{name}_{prop}"
            if prop != "id":
                table = self.graph.prop(self.pattern.vertices[name].label, prop).select(F.col("id").alias(f"{name}_id"), F.col(prop).alias(col))
                out = out.join(table, f"{name}_id", "left")
            cols.append(col)
        return out.select(*cols)


def union_orders(compiled: Compiled) -> DataFrame:
    """(plan, count) of every possible order: equal counts for plan tests."""
    parts = [compiled.count_in(o).withColumn("plan", F.lit("".join(o))) for o in compiled.pattern.orders()]
    return reduce(DataFrame.unionByName, parts)
