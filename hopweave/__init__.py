"""Variable-length graph pattern matching on Spark DataFrames."""

from hopweave.graph import PropertyGraph
from hopweave.plans.fluent import GraphPlan
from hopweave.plans.pattern import Pattern
from hopweave.plans.vql import query
from hopweave.schema import Direction, EdgeSchema, GraphSchema, Step, VertexSchema

__all__ = ["Direction", "EdgeSchema", "GraphPlan", "GraphSchema", "Pattern", "PropertyGraph", "Step", "VertexSchema", "query"]
