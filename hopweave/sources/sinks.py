"""Writers of graphs and results. Directories, one part file a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph


def native(graph: PropertyGraph, path: str) -> None:
    graph.save(path)


def csv(graph: PropertyGraph, path: str) -> None:
    """Vertex and edge tables as CSV without headers."""
    for v in graph.schema.vertices:
        graph.vertices(v.label).select(*[n for n, _ in v.properties]).write.mode("overwrite").csv(f"{path}/{v.label}", header=False)
    for e in graph.schema.edges:
        graph.edges(e.source, e.type, e.target).select("src", "dst").write.mode("overwrite").csv(f"{path}/{e.name}", header=False)


def label_graph(graph: PropertyGraph, path: str) -> None:
    """``edges`` lines "u v" and ``vertices`` lines "id community" of a social network."""
    graph.edges("Person", "knows", "Person").select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(f"{path}/edges")
    graph.vertices("Person").select(F.concat_ws(" ", "id", "community")).write.mode("overwrite").text(f"{path}/vertices")


def json_results(df: DataFrame, path: str) -> None:
    """One JSON array of a row's values a line below ``results``, nulls included, and one schema beside them."""
    texts = [F.to_json(F.struct(F.col(f"`{c}`").alias("x")), {"ignoreNullFields": "false"}) for c in df.columns]
    values = [F.substring(t, F.lit(6), F.length(t) - 6) for t in texts]  # without {"x": and }
    df.select(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")).alias("value")).write.mode("overwrite").text(f"{path}/results")
    df.sparkSession.range(1).select(F.lit(df.schema.json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def show(df: DataFrame, limit: int = 10) -> None:
    df.show(limit, False)
