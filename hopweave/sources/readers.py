"""Readers of raw graph files. Paths go to Spark's readers, so any store works."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.graph import PropertyGraph, dense_ids
from hopweave.schema import EdgeSchema, GraphSchema, VertexSchema

SOCIAL = GraphSchema("sn", [VertexSchema("Person", (("id", "long"), ("name", "string"), ("community", "int")))], [EdgeSchema("Person", "knows", "Person", directed=False, multiple=False)])
TRANSFERS = GraphSchema("bt", [VertexSchema("Account")], [EdgeSchema("Account", "transfer", "Account")])
FINANCE = GraphSchema(
    "ldbc-fin",
    [VertexSchema("Person"), VertexSchema("Account"), VertexSchema("Medium", (("id", "long"), ("isBlocked", "short"))), VertexSchema("Loan", (("id", "long"), ("balance", "long")))],
    [EdgeSchema("Person", "own", "Account", multiple=False), EdgeSchema("Account", "transfer", "Account"), EdgeSchema("Account", "withdraw", "Account"), EdgeSchema("Medium", "signIn", "Account"), EdgeSchema("Loan", "deposit", "Account")],
)
#: Sizes of the synthetic communities that a loaded social network gets, in vertices: fixed values.
COMMUNITY_SIZES = (2048, 2048, 2048, 20480, 20480, 20480, 204800, 204800, 204800, 2048000, 2048000, 2048000)


_BAD = "_row"


def csv(spark: SparkSession, path: str | list[str], sep: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """All columns as strings. ``columns`` names the first of them by position, for headers that
    repeat a name; rows may be longer than that. A row with fewer fields raises when it is read."""
    if columns is None:
        columns = spark.read.text(path).first()[0].split(sep) if header else [f"_c{i}" for i in range(len(spark.read.csv(path, sep=sep).columns))]
    schema = ", ".join(f"`{c}` string" for c in [*columns, _BAD])
    rows = spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD)
    # rows of another width are told by the reader; those that are longer have all that is asked for
    short = F.size(F.split(F.col(_BAD), F.lit(re.escape(sep)))) < len(columns)
    checked = F.when(short, F.raise_error(F.concat(F.lit(f"a row with fewer than {len(columns)} fields: "), F.col(_BAD))).cast("string")).otherwise(F.col(f"`{columns[0]}`"))
    return rows.select(checked.alias(columns[0]), *[F.col(f"`{c}`") for c in columns[1:]])


def _long(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(f"`{src}`").cast("long").alias(new) for new, src in names.items()])


def _short_name(col: str) -> F.Column:
    """Non-ASCII characters left out, 16 characters at most."""
    return F.substring(F.regexp_replace(col, r"[^\x20-\x7e]", ""), 1, 16)


def communities(ids: DataFrame) -> DataFrame:
    """(id, community): the synthetic communities over a shuffled order of ids, the rest tag 12."""
    ranked = dense_ids(ids.select(F.xxhash64("id", F.lit(1234)).alias("h"), "id").select(F.struct("h", "id").alias("id"))).select("id.id", "rank")
    tag, total = F.lit(len(COMMUNITY_SIZES)), 0
    bounds = []
    for size in COMMUNITY_SIZES:
        total += size
        bounds.append(total)
    for k in reversed(range(len(bounds))):
        tag = F.when(F.col("rank") < bounds[k], k).otherwise(tag)
    return ranked.select("id", tag.cast("int").alias("community"))


def _social(spark: SparkSession, persons: DataFrame, knows: DataFrame, dense: bool) -> PropertyGraph:
    persons = persons.join(communities(persons.select("id")), "id")
    return PropertyGraph.build(spark, SOCIAL, {"Person": persons}, {"Person_knows_Person": knows}, dense)


def ldbc_bi(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    """Part files below Person and Person_knows_Person, pipe separated."""
    p = csv(spark, f"{path}/Person", "|")
    k = csv(spark, f"{path}/Person_knows_Person", "|")
    persons = p.select(F.col("id").cast("long"), _short_name("firstName").alias("name"), F.col("LocationCityId").cast("long").alias("city"))
    return _social(spark, persons, _long(k, src="Person1Id", dst="Person2Id"), dense)


def ldbc_ic(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    """person_0_0.csv and person_knows_person_0_0.csv; the two ``Person.id`` columns go by position."""
    p = csv(spark, f"{path}/person_0_0.csv", "|")
    k = csv(spark, f"{path}/person_knows_person_0_0.csv", "|", ["src", "dst", "since"])
    persons = p.select(F.col("id").cast("long"), _short_name("firstName").alias("name"), F.col("place").cast("long").alias("city"))
    return _social(spark, persons, _long(k, src="src", dst="dst"), dense)


def _from_edges(spark: SparkSession, edges: DataFrame, dense: bool) -> PropertyGraph:
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    # names as the sources have none: sixteen letters that follow from the id
    return _social(spark, ids.withColumn("name", F.substring(F.translate(F.md5(F.col("id").cast("string").cast("binary")), "0123456789", "ghijklmnop"), 1, 16)), edges, dense)


def snap_txt(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    """Two ids a line apart by white space; lines with # are comments."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return _from_edges(spark, rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")), dense)


def snap_csv(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    return _from_edges(spark, _long(csv(spark, path, ","), src="node_1", dst="node_2"), dense)


def rabo(spark: SparkSession, path: str) -> PropertyGraph:
    """Accounts named by strings: ids are ranks over the whole file."""
    e = csv(spark, path, ";").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return PropertyGraph.build(spark, TRANSFERS, {"Account": ids}, {"Account_transfer_Account": e}, dense=True)


def finbench_transfers(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    e = _long(csv(spark, f"{path}/AccountTransferAccount.csv", "|"), src="fromId", dst="toId")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return PropertyGraph.build(spark, TRANSFERS, {"Account": ids}, {"Account_transfer_Account": e}, dense)


def finbench(spark: SparkSession, path: str, dense: bool = True) -> PropertyGraph:
    """The snapshot's four vertex and five edge files."""
    of = lambda name: csv(spark, f"{path}/{name}.csv", "|")
    vertices = {
        "Person": _long(of("Person"), id="personId"),
        "Account": _long(of("Account"), id="accountId"),
        "Medium": of("Medium").select(F.col("mediumId").cast("long").alias("id"), F.lower("isBlocked").isin("true", "1").cast("short").alias("isBlocked")),
        "Loan": of("Loan").select(F.col("loanId").cast("long").alias("id"), F.floor(F.col("balance").cast("double")).alias("balance")),
    }
    ends = {
        "Person_own_Account": ("PersonOwnAccount", "personId", "accountId"),
        "Account_transfer_Account": ("AccountTransferAccount", "fromId", "toId"),
        "Account_withdraw_Account": ("AccountWithdrawAccount", "fromId", "toId"),
        "Medium_signIn_Account": ("MediumSignInAccount", "mediumId", "accountId"),
        "Loan_deposit_Account": ("LoanDepositAccount", "loanId", "accountId"),
    }
    return PropertyGraph.build(spark, FINANCE, vertices, {k: _long(of(f), src=a, dst=b) for k, (f, a, b) in ends.items()}, dense)


def finbench_params(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """tcr1, 2, 6, 8: (id); tcr3: (id1, id2). Only the leading ids of each file are kept."""
    out = {}
    for k in (1, 2, 3, 6, 8):
        rows = csv(spark, f"{path}/complex_{k}_param.csv", "|", ["a", "b"])
        out[f"tcr{k}"] = _long(rows, id1="a", id2="b") if k == 3 else _long(rows, id="a")
    return out
