"""Conditions on vertex properties, combined by AND."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class VariableFilters:
    """A fluent list of conditions; ``columns`` is what a scan takes."""

    def __init__(self) -> None:
        self.columns: list[Column] = []

    def none(self, prop: str) -> VariableFilters:
        """No condition; named for symmetry."""
        return self

    def in_range(self, prop: str, low: object, high: object) -> VariableFilters:
        """Both ends inclusive."""
        self.columns.append(F.col(prop).between(low, high))
        return self

    def tag(self, prop: str, value: int) -> VariableFilters:
        return self.in_range(prop, value, value)

    def identity(self, value: int, prop: str = "id") -> VariableFilters:
        self.columns.append(F.col(prop) == value)
        return self

    def predicate(self, prop: str, test: Callable[[Column], Column]) -> VariableFilters:
        """``test`` maps the property's Column to a condition, so it stays in the JVM."""
        self.columns.append(test(F.col(prop)))
        return self
