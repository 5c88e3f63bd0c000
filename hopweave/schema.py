"""Graph schemas, directions and the edges that an expansion step uses."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum


class Direction(str, Enum):
    FORWARD = "forward"
    BACKWARD = "backward"
    BOTH = "both"
    UNDECIDED = "undecided"


@dataclass(frozen=True)
class VertexSchema:
    label: str
    properties: tuple[tuple[str, str], ...] = (("id", "long"),)
    count: int | None = None


@dataclass(frozen=True)
class EdgeSchema:
    source: str
    type: str
    target: str
    directed: bool = True
    multiple: bool = True
    count: int | None = None

    @property
    def name(self) -> str:
        return f"{self.source}_{self.type}_{self.target}"


@dataclass
class GraphSchema:
    name: str
    vertices: list[VertexSchema] = field(default_factory=list)
    edges: list[EdgeSchema] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> GraphSchema:
        raw = json.loads(text)
        vertices = [VertexSchema(v["label"], tuple(map(tuple, v["properties"])), v["count"]) for v in raw["vertices"]]
        return cls(raw["name"], vertices, [EdgeSchema(**e) for e in raw["edges"]])

    def vertex(self, label: str) -> VertexSchema:
        for v in self.vertices:
            if v.label == label:
                return v
        raise KeyError(f"no vertex label {label}")

    def edge(self, a: str, kind: str, b: str) -> EdgeSchema:
        """The edge schema of that type between the two labels, whichever end comes first."""
        for ends in ((a, b), (b, a)):
            for e in self.edges:
                if e.type == kind and (e.source, e.target) == ends:
                    return e
        raise KeyError(f"no edge {a}_{kind}_{b}")


@dataclass(frozen=True)
class Step:
    """One label of an expansion step."""

    source: str
    type: str
    target: str
    direction: Direction = Direction.UNDECIDED

    def resolve(self, edge: EdgeSchema) -> tuple[bool, bool]:
        """(use source to target, use target to source) of the stored edges.

        Undirected edges are stored both ways, so one reading suffices whatever
        direction is asked for."""
        same = edge.source == edge.target
        if not edge.directed:
            if not same:
                raise ValueError("undirected edges join one label with itself")
            return True, False
        d = self.direction
        if d == Direction.UNDECIDED:
            if same:
                raise ValueError(f"{edge.name}: a direction is needed")
            d = Direction.FORWARD if self.source == edge.source else Direction.BACKWARD
        if d == Direction.BOTH:
            if not same:
                raise ValueError(f"{edge.name}: both directions need one label")
            return True, True
        if self.source != (edge.source if d == Direction.FORWARD else edge.target):
            raise ValueError(f"{edge.name}: {d.value} does not start at {self.source}")
        return d == Direction.FORWARD, d == Direction.BACKWARD
