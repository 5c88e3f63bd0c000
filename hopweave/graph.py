"""A property graph: a DataFrame per vertex label and per edge type."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.schema import EdgeSchema, GraphSchema, Step, VertexSchema
from hopweave.storage import stored

Table = DataFrame | Callable[[], DataFrame]


class PropertyGraph:
    """Vertex tables have a column ``id``, edge tables ``src`` and ``dst``. Tables
    may be given as functions; they are then made at their first use."""

    def __init__(self, spark: SparkSession, schema: GraphSchema, vertices: Mapping[str, Table], edges: Mapping[str, Table]):
        self.spark, self.schema = spark, schema
        self._vertices, self._edges = dict(vertices), dict(edges)

    @staticmethod
    def _table(of: dict[str, Table], name: str) -> DataFrame:
        if callable(of[name]):
            of[name] = of[name]()
        return of[name]

    def vertices(self, label: str) -> DataFrame:
        self.schema.vertex(label)
        return self._table(self._vertices, label)

    def edges(self, a: str, kind: str, b: str) -> DataFrame:
        return self._table(self._edges, self.schema.edge(a, kind, b).name)

    def view(self, step: Step) -> DataFrame:
        """The (src, dst) pairs that a step with this label walks; repeated edges stay."""
        edge = self.schema.edge(step.source, step.type, step.target)
        ahead, back = step.resolve(edge)
        e = self._table(self._edges, edge.name).select("src", "dst")
        turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return e.union(turned) if ahead and back else e if ahead else turned

    def step(self, labels: Step | list[Step]) -> DataFrame:
        """The distinct pairs of a step with one or several labels (their union)."""
        labels = [labels] if isinstance(labels, Step) else labels
        if not labels or len({(s.source, s.target) for s in labels}) > 1:
            raise ValueError("the labels of a step start and end alike")
        out = self.view(labels[0])
        for s in labels[1:]:
            out = out.union(self.view(s))
        return out.distinct()

    def scan(self, label: str, properties: list[str] | None = None, where: list[Column] | Column | None = None) -> DataFrame:
        """Rows of a label: the given properties (all by default) that meet all conditions."""
        out = self.vertices(label)
        for c in [where] if isinstance(where, Column) else where or []:
            out = out.where(c)
        return out.select(*properties) if properties else out

    def neighbours(self, label: Step) -> DataFrame:
        """(src, dst) rows, repeated edges included: what a neighbour iterator walks."""
        return self.view(label)

    def prop(self, label: str, name: str) -> DataFrame:
        return self.vertices(label).select("id", name)

    # ------------------------------------------------------------ import rules

    @classmethod
    def build(cls, spark: SparkSession, schema: GraphSchema, vertices: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], dense: bool = False) -> PropertyGraph:
        """Apply what a schema says to raw tables: undirected edges get both
        orientations, edges without ``multiple`` are distinct, and with ``dense`` ids become
        their rank 0..n-1 in each label."""
        if dense:
            ranks = {v.label: dense_ids(vertices[v.label].select("id")) for v in schema.vertices}
            vertices = {k: v.join(ranks[k], "id").drop("id").withColumnRenamed("rank", "id") for k, v in vertices.items()}
            for e in schema.edges:
                a, b = ranks[e.source].toDF("src", "s"), ranks[e.target].toDF("dst", "t")
                edges = {**edges, e.name: edges[e.name].join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))}
        out = {}
        for e in schema.edges:
            t = edges[e.name]
            if not e.directed:
                t = t.union(t.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            out[e.name] = t if e.multiple else t.distinct()
        return cls(spark, schema, vertices, out)

    # ---------------------------------------------------------- load and store

    def save(self, path: str) -> None:
        """Parquet per table and the schema, with counts, as JSON."""
        vertices, edges = [], []
        for v in self.schema.vertices:
            t = self.vertices(v.label)
            t.write.mode("overwrite").parquet(f"{path}/vertex/{v.label}")
            vertices.append(VertexSchema(v.label, tuple(t.dtypes), t.count()))
        for e in self.schema.edges:
            t = self._table(self._edges, e.name)
            t.write.mode("overwrite").parquet(f"{path}/edge/{e.name}")
            edges.append(EdgeSchema(e.source, e.type, e.target, e.directed, e.multiple, t.count()))
        text = GraphSchema(self.schema.name, vertices, edges).to_json()
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/schema")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PropertyGraph:
        schema = GraphSchema.from_json(spark.read.text(f"{path}/schema").first()[0])
        vertices = {v.label: spark.read.parquet(f"{path}/vertex/{v.label}") for v in schema.vertices}
        return cls(spark, schema, vertices, {e.name: spark.read.parquet(f"{path}/edge/{e.name}") for e in schema.edges})


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``part`` and ``at``: rows dealt by ranges of ``order`` and numbered
    in each. No row order needs a single task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from pyspark.sql import Window

    dealt = stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    return dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, rank 0..n-1) of distinct ids in ascending order."""
    from pyspark.sql import Window

    rows = numbered(ids.distinct(), "id")
    # one row a part, so a window over all of them is small
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("at") - 1).alias("rank"))


def consecutive(df: DataFrame, value: str, *order: str) -> DataFrame:
    """(src, dst): each row's value with that of the next row in ``order``."""
    from pyspark.sql import Window

    rows = numbered(df.select(value, *order), *order)
    w = Window.partitionBy("part").orderBy("at")
    within = rows.select(F.col(value).alias("src"), F.lead(value).over(w).alias("dst"), "part")
    ends = rows.groupBy("part").agg(F.min_by(value, "at").alias("first"), F.max_by(value, "at").alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("part")).alias("dst"))
    return within.select("src", "dst").union(across).where("src is not null and dst is not null")
