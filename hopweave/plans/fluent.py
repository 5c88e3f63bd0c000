"""A fluent plan: each call wraps the DataFrame so far."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph
from hopweave.operators import aggregate, expand as ex, joins
from hopweave.schema import Direction, Step

ORDINAL = "_at"


class GraphPlan:
    """Immutable; ``df`` is the result so far. Inlined rows carry a hidden ordinal so
    that ``merge_flat`` can pair them by position."""

    def __init__(self, graph: PropertyGraph, rows: DataFrame | None = None):
        self.graph, self._rows = graph, rows

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(ORDINAL)

    def _with(self, rows: DataFrame) -> GraphPlan:
        return GraphPlan(self.graph, rows)

    # sources
    def inline(self, rows: list[tuple], schema: str) -> GraphPlan:
        return self._with(self.graph.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, {ORDINAL} long"))

    def inline_vid(self, name: str, ids: Iterable[int]) -> GraphPlan:
        return self.inline([(int(i),) for i in ids], f"{name} long")

    def inline_vid_range(self, name: str, low: int, high: int) -> GraphPlan:
        """Both ends inclusive."""
        return self._with(self.graph.spark.range(low, high + 1).select(F.col("id").alias(name), (F.col("id") - low).alias(ORDINAL)))

    def scan(self, label: str, name: str, where: list[Column] | Column | None = None) -> GraphPlan:
        return self._with(self.graph.scan(label, None, where).select(F.col("id").alias(name)))

    def merge_flat(self, other: GraphPlan) -> GraphPlan:
        return self._with(joins.zip_merge(self._rows, other._rows, ORDINAL))

    # expansion
    def csr_expand_to_neighbor(self, start: str, target: str, source: str, end: str, kind: str, direction: Direction = Direction.UNDECIDED, distance: bool = False) -> GraphPlan:
        return self._with(ex.neighbours(self.df, start, target, self.graph.step(Step(source, kind, end, direction)), distance))

    def vexpand(self, start: str, target: str, source: str, end: str, kind: str, k_min: int, k_max: int, direction: Direction, path: str = "any", distance: str | None = None, strategy: str = "auto") -> GraphPlan:
        return self.vexpand_multiple_edges(start, target, [Step(source, kind, end, direction)], k_min, k_max, path, distance, strategy)

    def vexpand_multiple_edges(self, start: str, target: str, labels: list[Step], k_min: int, k_max: int, path: str = "any", distance: str | None = None, strategy: str = "auto") -> GraphPlan:
        if k_max > 1 and any(s.source != s.target for s in labels):
            raise ValueError("several steps need edges that join a label with itself")
        return self._with(ex.expand(self.df, start, target, self.graph.step(labels), k_min, k_max, path, distance, strategy))

    def vexpand_different_edges_by_step(self, start: str, target: str, by_step: list[list[Step]], k_min: int, k_max: int, path: str = "any", distance: str | None = None, strategy: str = "auto") -> GraphPlan:
        return self._with(ex.expand(self.df, start, target, [self.graph.step(s) for s in by_step], k_min, k_max, path, distance, strategy))

    def vexpand_count(self, start: str, target: str, source: str, end: str, kind: str, k_min: int, k_max: int, direction: Direction, path: str = "any", alias: str = "count") -> GraphPlan:
        """(target, count): how many distinct starts reach each target; the pairs are not listed."""
        if k_max > 1 and source != end:
            raise ValueError("several steps need edges that join a label with itself")
        n = ex.bit_counts(self.df, start, self.graph.step(Step(source, kind, end, direction)), k_min, k_max, path)
        return self._with(n.select(F.col("v").alias(target), F.col("n").alias(alias)))

    def find_shortest(self, start: str, target: str, label: str, kind: str, direction: Direction) -> GraphPlan:
        return self._with(ex.find_shortest(self.df.select(start, target), start, target, self.graph.step(Step(label, kind, label, direction))))

    def _within(self, start: str, target: str, label: str, kind: str, direction: Direction, targets: DataFrame, k_min: int, k_max: int) -> GraphPlan:
        step = self.graph.step(Step(label, kind, label, direction))
        return self._with(ex.expand(self.df, start, target, step, k_min, k_max, "shortest", targets=targets))

    def vexpand_knows(self, start: str, target: str, targets: DataFrame, k_min: int, k_max: int) -> GraphPlan:
        """Shortest paths along ``knows`` that end in one of ``targets`` (ids in the first column)."""
        return self._within(start, target, "Person", "knows", Direction.BOTH, targets, k_min, k_max)

    def vexpand_transfer(self, start: str, target: str, targets: DataFrame, k_min: int, k_max: int) -> GraphPlan:
        """The same forward along ``transfer``."""
        return self._within(start, target, "Account", "transfer", Direction.FORWARD, targets, k_min, k_max)

    # the rest
    def filter_matrix(self, condition: Column) -> GraphPlan:
        return self._with(joins.pair_filter(self._rows, condition))

    def filter_exists(self, var: str, ids: DataFrame, id_col: str = "id") -> GraphPlan:
        """Rows whose variable is among the ids."""
        return self._with(joins.select_targets(self._rows, var, ids, id_col))

    def convert_to_flat(self) -> GraphPlan:
        """Pair tables are flat already."""
        return self

    def transpose(self) -> GraphPlan:
        return self._with(joins.transpose(self.df))

    def fetch_vertex_property(self, label: str, var: str, prop: str, alias: str | None = None) -> GraphPlan:
        return self._with(joins.fetch_property(self._rows, self.graph.vertices(label), var, prop, alias))

    def projection(self, columns: list[tuple[str, str]]) -> GraphPlan:
        return self._with(self.df.select(*[F.col(a).alias(b) for a, b in columns]))

    def remove_variable(self, name: str) -> GraphPlan:
        return self._with(self._rows.drop(name))

    def sum_group_by(self, key: str, value: str, alias: str | None = None) -> GraphPlan:
        return self.group_by(key, value, "sum", alias)

    def group_by(self, key: str, value: str, how: str | Callable[[str], Column], alias: str | None = None) -> GraphPlan:
        return self._with(aggregate.group_by(self.df, key, value, how, alias))

    def split_flat_by(self, key: str) -> dict[object, DataFrame]:
        return joins.split_by(self.df, key)

    def sort_by(self, *order: str | Column) -> GraphPlan:
        return self._with(joins.reorder(self._rows, *order))

    def free(self, fn: Callable[[DataFrame], DataFrame]) -> GraphPlan:
        """Any function of the DataFrame."""
        return self._with(self._rows.transform(fn))

    def run(self, limit: int = 10) -> DataFrame:
        """Print the first rows and return all."""
        self.df.show(limit, False)
        return self.df

    def run_print_all(self) -> DataFrame:
        for row in self.df.toLocalIterator():
            print(row)
        return self.df

    def run_quiet(self) -> DataFrame:
        return self.df

    def explain(self) -> None:
        self.df.explain("formatted")
