"""Counts and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def column_count(pairs: DataFrame, target: str, universe: DataFrame, order: str | None = None) -> DataFrame:
    """(target, count int) for every vertex of ``universe``, zeros included; ``order``
    "asc" or "desc" sorts by (count, target), ties in the same direction."""
    return with_zeros(pairs.distinct().groupBy(target).agg(F.count("*").alias("n")), target, universe, order)


def with_zeros(n: DataFrame, target: str, universe: DataFrame, order: str | None = None) -> DataFrame:
    """``column_count`` of counts (target, n) that are there already."""
    out = universe.select(F.col(universe.columns[0]).alias(target)).distinct().join(n, target, "left")
    out = out.select(target, F.coalesce("n", F.lit(0)).cast("int").alias("count"))
    if order is None:
        return out
    by = F.asc if order.lower() == "asc" else F.desc
    return out.orderBy(by("count"), by(target))


def row_or(pairs: DataFrame, target: str) -> DataFrame:
    """Distinct targets that any start reaches."""
    return pairs.select(target).distinct()


def group_by(df: DataFrame, key: str, value: str, how: str | Callable[[str], Column] = "sum", alias: str | None = None) -> DataFrame:
    """One aggregate by one key; sum, min and max keep the value's type. ``how`` may be any
    function that makes an aggregate Column of the value's name."""
    if callable(how):
        return df.groupBy(key).agg(how(value).alias(alias or f"AGG({value})"))
    if how not in AGGREGATES:
        raise ValueError(f"no aggregate {how}")
    agg = AGGREGATES[how](value)
    if how == "sum":
        agg = agg.cast(df.schema[value].dataType)
    return df.groupBy(key).agg(agg.alias(alias or f"{how.upper()}({value})"))


def visit_count(pairs: DataFrame, column: str) -> DataFrame:
    """Visited pairs by start or by target."""
    return pairs.groupBy(column).agg(F.count("*").alias("count"))


def layer_frequency(layers: list[DataFrame], detailed: bool = False) -> DataFrame:
    """How often each vertex stands in the layers; ``detailed`` by layer."""
    stacked = None
    for k, layer in enumerate(layers):
        part = layer.select("v", F.lit(k).alias("layer"))
        stacked = part if stacked is None else stacked.union(part)
    return stacked.groupBy("v", *(["layer"] if detailed else [])).agg(F.count("*").alias("frequency"))
