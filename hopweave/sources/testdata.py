"""The reference workloads' graphs, derived from the generated business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph, consecutive
from hopweave.schema import EdgeSchema, GraphSchema, VertexSchema
from hopweave.sources.readers import FINANCE, SOCIAL
from hopweave.storage import stored

#: Both graphs in one: the social network's persons are customers, the bank's are nations.
SCHEMA = GraphSchema("testdata", [*SOCIAL.vertices, *[v if v.label != "Person" else VertexSchema("Owner") for v in FINANCE.vertices]], [*SOCIAL.edges, *[e if e.type != "own" else EdgeSchema("Owner", "own", "Account", multiple=False) for e in FINANCE.edges]])

_GRAPHS: dict[tuple[str, str], PropertyGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Tables are made when first used and kept as files while the application runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = _graph(spark, sf_dir)
    return _GRAPHS[key]


def _graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    memo: dict[str, DataFrame] = {}

    def transfer() -> DataFrame:
        if "transfer" not in memo:
            memo["transfer"] = stored(consecutive(t("orders"), "o_custkey", "o_orderkey"), "transfer")
        return memo["transfer"]

    def knows() -> DataFrame:
        e = transfer()
        return stored(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "knows")

    def sign_in() -> DataFrame:
        first = t("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
        return first.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"))

    vertices = {
        "Person": lambda: t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("community")),
        "Owner": lambda: t("nation").select(F.col("n_nationkey").cast("long").alias("id")),
        "Account": lambda: t("customer").select(F.col("c_custkey").alias("id")),
        "Medium": lambda: t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 1000).cast("short").alias("isBlocked")),
        "Loan": lambda: t("orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("balance")),
    }
    edges = {
        "Person_knows_Person": knows,
        "Account_transfer_Account": transfer,
        "Account_withdraw_Account": lambda: stored(consecutive(t("orders"), "o_custkey", "o_orderdate", "o_orderkey"), "withdraw"),
        "Owner_own_Account": lambda: t("customer").select(F.col("c_nationkey").cast("long").alias("src"), F.col("c_custkey").alias("dst")).distinct(),
        "Medium_signIn_Account": lambda: stored(sign_in(), "sign-in"),
        "Loan_deposit_Account": lambda: t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")),
    }
    return PropertyGraph(spark, SCHEMA, vertices, edges)
