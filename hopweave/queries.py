"""The registered graph queries, each with its SQL.

Graphs: ``sources.testdata``. Communities of (a, b, c, d) are (0, 1, 2, 0); k_min is 0
and paths are shortest where a case study says nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.filters import VariableFilters
from hopweave.graph import PropertyGraph
from hopweave.operators import aggregate, expand as ex, joins
from hopweave.plans.fluent import GraphPlan
from hopweave.plans.pattern import Compiled, Pattern
from hopweave.plans.vql import query
from hopweave.schema import Direction, Step
from hopweave.sources import readers, sinks, testdata
from hopweave.storage import shared_dir, stored

COMMUNITY = {"a": 0, "b": 1, "c": 2, "d": 0}
K_MAX = 2
FWD, BACK, BOTH = Direction.FORWARD, Direction.BACKWARD, Direction.BOTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------------ SQL

_TABLES = {
    "person": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS community, c_acctbal AS acctbal FROM customer",
    "account": "SELECT c_custkey AS id FROM customer",
    "transfer": "SELECT * FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
    "withdraw": "SELECT * FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
    "knows": "SELECT src, dst FROM transfer UNION SELECT dst, src FROM transfer",
    "own": "SELECT DISTINCT c_nationkey::BIGINT AS src, c_custkey AS dst FROM customer",
    "loan": "SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS balance FROM orders",
    "deposit": "SELECT o_orderkey AS src, o_custkey AS dst FROM orders",
    "medium": "SELECT s_suppkey AS id, (s_acctbal < 1000)::SMALLINT AS isBlocked FROM supplier",
    "signin": "SELECT l_suppkey AS src, o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1",
}


def sql(body: str, *ctes: str) -> str:
    """``body`` over the graph's tables; ctes are "name AS (...)" strings."""
    return "WITH RECURSIVE " + ",\n".join([*[f"{k} AS ({v})" for k, v in _TABLES.items()], *ctes]) + "\n" + body


def walk(name: str, starts: str, edges: str, k_max: int) -> str:
    """A CTE of (s, v, k): v stands at the end of a walk of k steps from s. ``edges``: a query for (src, dst[, k])."""
    by_step = " AND e.k = w.k + 1" if " k" in edges.lower().split(" from ")[0] else ""
    return f"{name}(s, v, k) AS (SELECT id, id, 0 FROM ({starts}) UNION SELECT w.s, e.dst, w.k + 1 FROM {name} w JOIN ({edges}) e ON w.v = e.src{by_step} WHERE w.k < {k_max})"


FWD_SQL, BACK_SQL = "SELECT src, dst FROM transfer", "SELECT dst AS src, src AS dst FROM transfer"
BOTH_SQL = f"{FWD_SQL} UNION {BACK_SQL}"
NATION0 = "SELECT id FROM person WHERE community = 0"


def register(name: str, text: str) -> Callable:
    def put(fn: Callable[[PropertyGraph], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(testdata.graph(spark, sf_dir))
        SQL[name] = text
        return fn

    return put


def group(g: PropertyGraph, tag: int, name: str = "id") -> DataFrame:
    return g.scan("Person", None, F.col("community") == tag).select(F.col("id").alias(name))


def step(g: PropertyGraph, kind: str = "transfer", direction: Direction = FWD) -> DataFrame:
    label = "Person" if kind == "knows" else "Account"
    return g.step(Step(label, kind, label, direction))


def plan(g: PropertyGraph) -> GraphPlan:
    return GraphPlan(g)


# ------------------------------------------------------- scans and projections


@register("scan_all", sql("SELECT id, name, community FROM person"))
def _(g):
    return g.scan("Person")


@register("scan_tag_range", sql("SELECT id, community FROM person WHERE community BETWEEN 1 AND 3"))
def _(g):
    return g.scan("Person", ["id", "community"], VariableFilters().in_range("community", 1, 3).columns)


@register("scan_predicate", sql("SELECT id, name FROM person WHERE name LIKE '%7' AND community IN (0, 5, 9)"))
def _(g):
    f = VariableFilters().none("id").predicate("name", lambda c: c.endswith("7")).predicate("community", lambda c: c.isin(0, 5, 9))
    return g.scan("Person", ["id", "name"], f.columns)


@register("scan_id", sql("SELECT id, name, community FROM person WHERE id = 5"))
def _(g):
    return g.scan("Person", None, VariableFilters().identity(5).columns)


@register("inline_vid_range", "SELECT range AS v FROM range(3, 18)")
def _(g):
    return plan(g).inline_vid_range("v", 3, 17).df


@register("inline_vid", "SELECT * FROM (VALUES (5::BIGINT), (3), (5)) t(v)")
def _(g):
    return plan(g).inline_vid("v", [5, 3, 5]).df


@register("projection", sql("SELECT community AS tag, id AS person_id FROM person"))
def _(g):
    return plan(g).scan("Person", "id").fetch_vertex_property("Person", "id", "community").projection([("community", "tag"), ("id", "person_id")]).df


@register("drop_variable", sql("SELECT id, community FROM person"))
def _(g):
    return g.scan("Person").drop("name")


@register("fetch_property", sql("SELECT src, dst, name AS dst_name FROM knows JOIN person ON dst = id"))
def _(g):
    return joins.fetch_property(g.edges("Person", "knows", "Person").select("src", "dst"), g.vertices("Person"), "dst", "name", "dst_name")


# ------------------------------------------------------------------ expansion


@register("expand_neighbor_fwd", sql("SELECT DISTINCT src AS a, dst AS b FROM own"))
def _(g):
    return plan(g).scan("Owner", "a").csr_expand_to_neighbor("a", "b", "Owner", "Account", "own").df


@register("expand_neighbor_bwd", sql("SELECT DISTINCT dst AS a, src AS b FROM deposit"))
def _(g):
    return plan(g).scan("Account", "a").csr_expand_to_neighbor("a", "b", "Account", "Loan", "deposit").df


@register("expand_neighbor_distance", sql("SELECT DISTINCT src AS a, dst AS b, 1 AS distance FROM transfer"))
def _(g):
    return plan(g).scan("Account", "a").csr_expand_to_neighbor("a", "b", "Account", "Account", "transfer", FWD, True).df


def _walks(name: str, select: str, edges_sql: str, k_min: int, k_max: int, path: str, distance: str | None, edges: Callable[[PropertyGraph], object], strategy: str = "auto") -> None:
    text = sql(select, walk("w", NATION0, edges_sql, k_max))
    register(name, text)(lambda g: ex.expand(group(g, 0, "a"), "a", "b", edges(g), k_min, k_max, path, distance, strategy))


_SHORTEST = "SELECT s AS a, v AS b{} FROM (SELECT s, v, min(k) AS k FROM w GROUP BY 1, 2) WHERE k BETWEEN {} AND {}"
_walks("vexpand_any", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", FWD_SQL, 1, 2, "any", None, step)
_walks("vexpand_any_kmin0", "SELECT DISTINCT s AS a, v AS b FROM w", FWD_SQL, 0, 2, "any", None, step, "bits")
_walks("vexpand_any_distance", "SELECT s AS a, v AS b, k AS distance FROM w WHERE k BETWEEN 1 AND 3", FWD_SQL, 1, 3, "any", "all", step)
_walks("vexpand_any_min_distance", "SELECT s AS a, v AS b, min(k) AS distance FROM w WHERE k BETWEEN 1 AND 3 GROUP BY 1, 2", FWD_SQL, 1, 3, "any", "min", step)
_walks("vexpand_shortest", _SHORTEST.format("", 0, 3), FWD_SQL, 0, 3, "shortest", None, step, "bits")
_walks("vexpand_shortest_distance", _SHORTEST.format(", k AS distance", 1, 3), FWD_SQL, 1, 3, "shortest", "all", step)
_walks("vexpand_shortest_both", _SHORTEST.format(", k AS distance", 0, 2), BOTH_SQL, 0, 2, "shortest", "all", lambda g: step(g, "transfer", BOTH))
_walks("vexpand_backward", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", BACK_SQL, 1, 2, "any", None, lambda g: step(g, "transfer", BACK))
_walks("vexpand_multi_label", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", "SELECT src, dst FROM transfer UNION SELECT src, dst FROM withdraw", 1, 2, "any", None, lambda g: g.step([Step("Account", "transfer", "Account", FWD), Step("Account", "withdraw", "Account", FWD)]))
_walks("vexpand_per_step", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", "SELECT src, dst, 1 AS k FROM transfer UNION SELECT dst, src, 2 FROM withdraw", 1, 2, "any", None, lambda g: [step(g), step(g, "withdraw", BACK)])
_walks("pure_expand", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", "SELECT src, dst FROM knows", 1, 2, "any", None, lambda g: step(g, "knows", BOTH), "bits")
_walks("pure_expand_csr", "SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2", "SELECT src, dst FROM knows", 1, 2, "any", None, lambda g: step(g, "knows", BOTH), "pairs")


@register("vexpand_bag_starts", sql("SELECT x.c AS a, v AS b FROM (VALUES (1::BIGINT), (1), (2)) x(c) JOIN (SELECT DISTINCT s, v FROM w WHERE k = 2) ON s = x.c", walk("w", "SELECT id FROM person WHERE id IN (1, 2)", FWD_SQL, 2)))
def _(g):
    return plan(g).inline_vid("a", [1, 1, 2]).vexpand("a", "b", "Account", "Account", "transfer", 2, 2, FWD).df


_PAIRS = "SELECT i AS s, CASE WHEN i % 7 = 0 THEN i WHEN i % 5 = 0 THEN -5 ELSE i + 100 END AS t FROM range(20) r(i)"


@register("find_shortest", sql("SELECT p.s AS a, p.t AS b, coalesce(min(k), -1)::INT AS distance FROM p LEFT JOIN w ON p.s = w.s AND p.t = w.v GROUP BY 1, 2", f"p AS ({_PAIRS})", walk("w", "SELECT range AS id FROM range(20)", FWD_SQL, 50)))
def _(g):
    i = F.col("a")
    pairs = g.spark.range(20).toDF("a").select("a", F.when(i % 7 == 0, i).when(i % 5 == 0, F.lit(-5)).otherwise(i + 100).cast("long").alias("b"))
    return ex.find_shortest(pairs, "a", "b", step(g))


# -------------------------------------------------------------- pair operators

_REACH2 = walk("w", NATION0, FWD_SQL, 2)
_PAIRS2 = "r AS (SELECT DISTINCT s AS a, v AS b FROM w WHERE k BETWEEN 1 AND 2)"


def reach2(g: PropertyGraph) -> DataFrame:
    return ex.expand(group(g, 0, "a"), "a", "b", step(g), 1, 2)


@register("select_targets", sql("SELECT a, b FROM r WHERE b IN (SELECT id FROM person WHERE community = 1)", _REACH2, _PAIRS2))
def _(g):
    return joins.select_targets(reach2(g), "b", group(g, 1), "id")


@register("pair_filter", sql("SELECT a, b FROM r WHERE a < b AND b % 3 = 1", _REACH2, _PAIRS2))
def _(g):
    return joins.pair_filter(reach2(g), (F.col("a") < F.col("b")) & (F.col("b") % 3 == 1))


@register("transpose", sql("SELECT b, a FROM r", _REACH2, _PAIRS2))
def _(g):
    return joins.transpose(reach2(g))


def _edge_tables(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    t = g.edges("Account", "transfer", "Account")
    return t.select(F.col("src").alias("a"), F.col("dst").alias("m")), g.edges("Account", "withdraw", "Account").select(F.col("src").alias("m"), F.col("dst").alias("b"))


@register("hash_join", sql("SELECT t.src AS a, t.dst AS m, w.dst AS b FROM transfer t JOIN withdraw w ON t.dst = w.src"))
def _(g):
    return joins.hash_join(*_edge_tables(g), "m")


@register("hash_join_count", sql("SELECT count(*) AS count FROM transfer t JOIN withdraw w ON t.dst = w.src"))
def _(g):
    return joins.hash_join_count(*_edge_tables(g), "m")


@register("boolean_product", sql("SELECT DISTINCT t.src AS a, w.dst AS b FROM transfer t JOIN withdraw w ON t.dst = w.src"))
def _(g):
    return joins.boolean_product(*_edge_tables(g), "m")


def _orders(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    t = g.edges("Account", "transfer", "Account").select("src", "dst", (F.col("src") % 5).alias("x"), (F.col("dst") % 3).alias("y"))
    w = g.edges("Account", "withdraw", "Account").select("src", "dst", (F.col("dst") % 5).alias("x"), (F.col("src") % 3).alias("y"))
    return t, w


_SEMI = ("t AS (SELECT src, dst, src % 5 AS x, dst % 3 AS y FROM transfer)", "u AS (SELECT src, dst, dst % 5 AS x, src % 3 AS y FROM withdraw)")
for _n, _keys in enumerate((["src"], ["src", "dst"], ["src", "dst", "x"], ["src", "dst", "x", "y"]), 1):
    _on = " AND ".join(f"t.{k} = u.{k}" for k in _keys)
    register(f"semi_join_{_n}", sql(f"SELECT * FROM t WHERE EXISTS (SELECT 1 FROM u WHERE {_on})", *_SEMI))(lambda g, keys=_keys: joins.semi_join(*_orders(g), keys))
register("semi_join_count", sql("SELECT count(*) AS count FROM t WHERE EXISTS (SELECT 1 FROM u WHERE t.src = u.src AND t.dst = u.dst)", *_SEMI))(lambda g: joins.semi_join_count(*_orders(g), ["src", "dst"]))


def _triangle(g: PropertyGraph) -> tuple[DataFrame, list[DataFrame]]:
    base = g.edges("Account", "transfer", "Account").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    k = g.edges("Person", "knows", "Person")
    return base, [k.select(F.col("src").alias("a"), F.col("dst").alias("c")), k.select(F.col("dst").alias("c"), F.col("src").alias("b"))]


_TRIANGLE = "FROM transfer t JOIN knows x ON x.src = t.src JOIN knows y ON y.src = t.dst AND y.dst = x.dst"
register("mintersect", sql(f"SELECT t.src AS a, t.dst AS b, x.dst AS c {_TRIANGLE}"))(lambda g: joins.mintersect(_triangle(g)[0], "c", _triangle(g)[1]))
register("mintersect_count", sql(f"SELECT count(*) AS count {_TRIANGLE}"))(lambda g: joins.mintersect_count(_triangle(g)[0], "c", _triangle(g)[1]))


@register("zip_merge", "SELECT i + 3 AS a, 29 - i AS b FROM range(20) r(i)")
def _(g):
    return plan(g).inline_vid_range("a", 3, 22).merge_flat(plan(g).inline_vid("b", range(29, 9, -1))).df


# ----------------------------------------------------------------- aggregation

register("count", sql("SELECT count(*) AS count FROM r", _REACH2, _PAIRS2))(lambda g: joins.count(reach2(g)))
_REACH1, _PAIRS1 = walk("w", NATION0, FWD_SQL, 1), "r AS (SELECT DISTINCT s AS a, v AS b FROM w WHERE k = 1)"
_COLUMN = "SELECT id AS b, count(a)::INT AS count FROM account LEFT JOIN r ON id = b GROUP BY 1"
register("column_count", sql(_COLUMN, _REACH1, _PAIRS1))(lambda g: aggregate.column_count(ex.expand(group(g, 0, "a"), "a", "b", step(g)), "b", g.vertices("Account")))
register("column_count_asc", sql(f"SELECT *, row_number() OVER (ORDER BY count, b)::INT AS rank FROM ({_COLUMN})", _REACH1, _PAIRS1))(lambda g: joins.ranked(aggregate.column_count(ex.expand(group(g, 0, "a"), "a", "b", step(g)), "b", g.vertices("Account")), "count", "b"))
register("row_or", sql("SELECT DISTINCT b FROM r", _REACH2, _PAIRS2))(lambda g: aggregate.row_or(reach2(g), "b"))


def _balances(g: PropertyGraph) -> DataFrame:
    return joins.fetch_property(g.edges("Loan", "deposit", "Account").select(F.col("src").alias("loan"), F.col("dst").alias("account")), g.vertices("Loan"), "loan", "balance").select("account", "balance")


def _spread(value: str) -> Column:
    """An aggregate of the user's own."""
    return F.max(value) - F.min(value)


for _how, _expr in (("sum", "sum(balance)::BIGINT"), ("count", "count(balance)"), ("min", "min(balance)"), ("max", "max(balance)"), ("avg", "sum(balance)::DOUBLE / count(balance)"), ("spread", "max(balance) - min(balance)")):
    register(f"group_{_how}", sql(f"SELECT dst AS account, {_expr} AS value FROM deposit JOIN loan ON src = id GROUP BY 1"))(lambda g, how=_how: aggregate.group_by(_balances(g), "account", "balance", _spread if how == "spread" else how, "value"))

register("source_visit_count", sql("SELECT a, count(*) AS count FROM r GROUP BY 1", _REACH2, _PAIRS2))(lambda g: aggregate.visit_count(reach2(g), "a"))
register("target_visit_count", sql("SELECT b, count(*) AS count FROM r GROUP BY 1", _REACH2, _PAIRS2))(lambda g: aggregate.visit_count(reach2(g), "b"))
register("layer_frequency", sql("SELECT v, count(*) AS frequency FROM w GROUP BY 1", _REACH2))(lambda g: aggregate.layer_frequency(ex.layers(group(g, 0, "s"), step(g), 2)))
register("layer_frequency_detailed", sql("SELECT v, k AS layer, count(*) AS frequency FROM w GROUP BY 1, 2", _REACH2))(lambda g: aggregate.layer_frequency(ex.layers(group(g, 0, "s"), step(g), 2), True))


def _two_sets(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    return g.edges("Account", "transfer", "Account").select("src", "dst"), g.edges("Account", "withdraw", "Account").select("src", "dst")


register("union_layers", sql("SELECT src, dst FROM transfer UNION SELECT src, dst FROM withdraw"))(lambda g: joins.union_pairs(*_two_sets(g)))
register("visited_difference", sql("SELECT src, dst FROM transfer EXCEPT SELECT src, dst FROM withdraw"))(lambda g: joins.difference(*_two_sets(g)))
register("column_and", sql("SELECT src, dst FROM transfer INTERSECT SELECT src, dst FROM withdraw"))(lambda g: joins.intersection(*_two_sets(g)))
register("complement", sql("SELECT p.id AS src, q.id AS dst FROM person p, person q WHERE p.community = 0 AND q.community = 1 AND NOT EXISTS (SELECT 1 FROM transfer t WHERE t.src = p.id AND t.dst = q.id)"))(lambda g: joins.complement(g.edges("Account", "transfer", "Account").select("src", "dst"), group(g, 0, "src"), group(g, 1, "dst")))
register("reorder", sql("SELECT id, community, row_number() OVER (ORDER BY community DESC, id)::INT AS rank FROM person"))(lambda g: joins.ranked(g.scan("Person", ["id", "community"]), F.desc("community"), "id"))
register("top_k", sql("SELECT id, balance FROM loan ORDER BY balance DESC, id LIMIT 25"))(lambda g: joins.top_k(g.scan("Loan", ["id", "balance"]), 25, F.desc("balance"), "id"))


@register("split_by", sql("SELECT community, id FROM person WHERE community < 4"))
def _(g):
    parts = joins.split_by(g.scan("Person", ["id", "community"], F.col("community") < 4), "community")
    return joins.reduce(DataFrame.union, [d.select(F.lit(k).alias("community"), "id") for k, d in parts.items()])


# ---------------------------------------------------------------- case studies

_KNOWS = "SELECT src, dst FROM knows"


def _near(name: str, tag: int, k: int) -> str:
    return walk(name, f"SELECT id FROM person WHERE community = {tag}", _KNOWS, k)


def near(g: PropertyGraph, a: str, b: str, k: int) -> DataFrame:
    p = Pattern()
    for v in (a, b):
        p.create_vertex(v, "Person", F.col("community") == COMMUNITY.get(v, 0))
    p.connect(a, b, "knows", 0, k, "shortest")
    return Compiled(g, p).rows()


_IN0 = "v IN (SELECT id FROM person WHERE community = 0)"
register("e1", sql(f"SELECT count(*) AS count FROM (SELECT DISTINCT s, v FROM w) WHERE {_IN0}", _near("w", 0, 3)))(lambda g: joins.count(near(g, "a", "d", 3)))


def _counts(g: PropertyGraph) -> DataFrame:
    """How many of community 0 reach each person, on packed words."""
    return ex.bit_counts(group(g, 0, "p"), "p", step(g, "knows", BOTH), 0, 3, "shortest").withColumnRenamed("v", "q")


_CASE2 = "SELECT id AS q, count(s)::INT AS count FROM person LEFT JOIN (SELECT DISTINCT s, v FROM w) ON id = v {} GROUP BY 1"
register("e2", sql(_CASE2.format(""), _near("w", 0, 3)))(lambda g: aggregate.with_zeros(_counts(g), "q", g.vertices("Person"), "desc"))
register("e3", sql(_CASE2.format("WHERE community = 0"), _near("w", 0, 3)))(lambda g: aggregate.column_count(plan(g).scan("Person", "p", F.col("community") == 0).vexpand_knows("p", "q", group(g, 0), 0, 3).df, "q", group(g, 0), "asc"))
register("e5", sql("SELECT DISTINCT v AS q FROM w", _near("w", 0, 3)))(lambda g: ex.reached(group(g, 0, "p"), "p", step(g, "knows", BOTH), 3).withColumnRenamed("v", "q"))
_RISK = walk("w", "SELECT range AS id FROM range(20)", FWD_SQL, 3)
register("e6", sql("SELECT DISTINCT s AS a, v AS b FROM w WHERE v < 20", _RISK))(lambda g: plan(g).inline_vid_range("a", 0, 19).vexpand("a", "b", "Account", "Account", "transfer", 0, 3, FWD, "shortest").filter_exists("b", g.spark.range(20)).df)
register("e7", sql("SELECT DISTINCT s AS a, v AS b FROM w", _RISK))(lambda g: plan(g).inline_vid_range("a", 0, 19).vexpand("a", "b", "Account", "Account", "transfer", 0, 3, FWD, "shortest").df)

#: The eight pattern shapes, as edges.
SHAPES = {
    "p1": ["ab"],
    "p2": ["ab", "bc"],
    "p3": ["ab", "bc", "ac"],
    "p4": ["ab", "bc", "cd"],
    "p5": ["ab", "bc", "cd", "ad"],
    "p6": ["ab", "bc", "ac", "ad"],
    "p7": ["ab", "ac", "ad", "bc", "cd"],
    "p8": ["ab", "ac", "ad", "bc", "bd", "cd"],
}


def shape(g: PropertyGraph, edges: list[str], k_max: int = K_MAX) -> Compiled:
    p = Pattern()
    for v in sorted(set("".join(edges))):
        p.create_vertex(v, "Person", F.col("community") == COMMUNITY[v])
    for a, b in edges:
        p.connect(a, b, "knows", 0, k_max, "shortest")
    return Compiled(g, p)


def shape_sql(edges: list[str], k_max: int = K_MAX) -> str:
    names = sorted(set("".join(edges)))
    near_ = [_near(f"w{t}", t, k_max) for t in sorted({COMMUNITY[a] for a, _ in edges})]
    pairs = [f"{a}{b} AS MATERIALIZED (SELECT DISTINCT s AS {a}, v AS {b} FROM w{COMMUNITY[a]} WHERE v IN (SELECT id FROM person WHERE community = {COMMUNITY[b]}))" for a, b in edges]
    seen, body = set(edges[0]), edges[0]
    left = list(edges[1:])
    while left:
        e = next(e for e in left if set(e) & seen)
        body += f" JOIN {e} USING ({', '.join(c for c in e if c in seen)})"
        seen |= set(e)
        left.remove(e)
    return sql(f"SELECT count(*) AS count FROM (SELECT {', '.join(names)} FROM {body})", *near_, *pairs)


for _name, _edges in SHAPES.items():
    register(_name, shape_sql(_edges))(lambda g, e=_edges: shape(g, e).count())
register("e4", shape_sql(SHAPES["p3"]))(lambda g: joins.count(shape(g, SHAPES["p3"]).rows()))
register("p3_semi_join", shape_sql(SHAPES["p3"]))(lambda g: _p3(shape(g, SHAPES["p3"])))


def _p3(c: Compiled) -> DataFrame:
    ab, bc, ac = (c.pairs(e) for e in c.pattern.edges)
    return joins.semi_join_count(joins.hash_join(ab, bc, "b_id"), ac, ["a_id", "c_id"])


def _p_plan(name: str, edges: list[str]) -> None:
    """Every order of a shape gives the same count: the least and the greatest of them."""
    from hopweave.plans.pattern import union_orders

    both = shape_sql(edges).replace("SELECT count(*) AS count FROM", "SELECT count(*) AS least, count(*) AS most FROM")
    register(name, both)(lambda g: union_orders(shape(g, edges)).agg(F.min("count").alias("least"), F.max("count").alias("most")))


_p_plan("p3_all_plans", SHAPES["p3"])
_p_plan("p5_all_plans", SHAPES["p5"])

# ------------------------------------------------------------ FinBench queries


@register("tcr1", sql("SELECT s AS account_id, v AS other_id, k AS distance FROM (SELECT s, v, min(k) AS k FROM w GROUP BY 1, 2) WHERE k BETWEEN 1 AND 3 AND v IN (SELECT dst FROM signin JOIN medium ON src = id WHERE isBlocked = 1)", walk("w", "SELECT dst AS id FROM own WHERE src = 0", FWD_SQL, 3)))
def _(g):
    blocked = g.neighbours(Step("Medium", "signIn", "Account")).join(g.scan("Medium", ["id"], F.col("isBlocked") == 1), F.col("src") == F.col("id")).select(F.col("dst").alias("id"))
    p = plan(g).inline_vid("person_id", [0]).csr_expand_to_neighbor("person_id", "account_id", "Owner", "Account", "own")
    return p.vexpand("account_id", "other_id", "Account", "Account", "transfer", 1, 3, FWD, "shortest", "all").filter_exists("other_id", blocked).df


def _tcr2(g: PropertyGraph, starts: GraphPlan) -> DataFrame:
    # an account's loans count once for each start that reaches it
    n = stored(starts.vexpand_count("account_id", "other_id", "Account", "Account", "transfer", 1, 3, BACK, alias="n").df, "counts")
    p = GraphPlan(g, n).csr_expand_to_neighbor("other_id", "loan_id", "Account", "Loan", "deposit")
    p = p.fetch_vertex_property("Loan", "loan_id", "balance").remove_variable("loan_id").sum_group_by("other_id", "balance", "once")
    return p.df.join(n, "other_id").select("other_id", (F.col("once") * F.col("n")).alias("sum_balance"))


_TCR2 = "SELECT o.v AS other_id, sum(balance)::BIGINT AS sum_balance FROM (SELECT DISTINCT s, v FROM w WHERE k BETWEEN 1 AND 3) o JOIN (SELECT DISTINCT src, dst FROM deposit) d ON d.dst = o.v JOIN loan ON d.src = id GROUP BY 1"
register("tcr2", sql(_TCR2, walk("w", "SELECT dst AS id FROM own WHERE src = 0", BACK_SQL, 3)))(lambda g: _tcr2(g, plan(g).inline_vid("person_id", [0]).csr_expand_to_neighbor("person_id", "account_id", "Owner", "Account", "own")))
register("tcr2_single_point", sql(_TCR2, walk("w", "SELECT 7::BIGINT AS id", BACK_SQL, 3)))(lambda g: _tcr2(g, plan(g).inline_vid("account_id", [7])))


@register("tcr3", sql("SELECT p.s AS start, p.t AS target, coalesce(min(k), -1)::INT AS distance FROM p LEFT JOIN w ON p.s = w.s AND p.t = w.v GROUP BY 1, 2", "p AS (SELECT i AS s, i + 100 AS t FROM range(20) r(i))", walk("w", "SELECT range AS id FROM range(20)", FWD_SQL, 50)))
def _(g):
    return plan(g).inline_vid_range("start", 0, 19).merge_flat(plan(g).inline_vid_range("target", 100, 119)).find_shortest("start", "target", "Account", "transfer", FWD).df


@register("tcr6", sql("SELECT DISTINCT s AS dst, v AS src FROM w WHERE k BETWEEN 1 AND 2", walk("w", NATION0, "SELECT dst AS src, src AS dst, 1 AS k FROM withdraw UNION SELECT dst, src, 2 FROM transfer", 2)))
def _(g):
    by_step = [[Step("Account", "withdraw", "Account", BACK)], [Step("Account", "transfer", "Account", BACK)]]
    return GraphPlan(g, group(g, 0, "dst")).vexpand_different_edges_by_step("dst", "src", by_step, 1, 2).convert_to_flat().df


@register("tcr8", sql("SELECT d.dst AS src, v AS dst FROM (SELECT DISTINCT src, dst FROM deposit WHERE src < 5) d JOIN (SELECT DISTINCT s, v FROM w WHERE k BETWEEN 1 AND 3) ON s = d.dst", walk("w", "SELECT DISTINCT dst AS id FROM deposit WHERE src < 5", "SELECT src, dst FROM transfer UNION SELECT src, dst FROM withdraw", 3)))
def _(g):
    both = [Step("Account", "withdraw", "Account", FWD), Step("Account", "transfer", "Account", FWD)]
    p = plan(g).inline_vid_range("loan", 0, 4).csr_expand_to_neighbor("loan", "src", "Loan", "Account", "deposit")
    return p.vexpand_different_edges_by_step("src", "dst", [both] * 3, 1, 3).convert_to_flat().df


# ------------------------------------------------------------------ query text

_TRI1 = "FROM knows x JOIN knows y ON y.src = x.dst JOIN knows z ON z.src = x.src AND z.dst = y.dst JOIN person a ON a.id = x.src JOIN person b ON b.id = x.dst JOIN person c ON c.id = y.dst WHERE a.community BETWEEN 0 AND 5 AND b.community BETWEEN 0 AND 11"
_VQL = "vmatch (a{tag:0-5})->(b{tag:0-11}), (b)-[1]-(c), (a)-[..1]->(c) return "
register("vql_triangle_count", sql(f"SELECT count(*) AS count {_TRI1}"))(lambda g: query(g, _VQL + "count of a;"))
register("vql_projection", sql(f"SELECT a.id AS a_id, b.community AS b_community, c.id AS c_id {_TRI1}"))(lambda g: query(g, _VQL + "a.id, b.community, c;"))


# ------------------------------------------------------------ sources and sinks
#
# Each writes the graph's tables below the shared folder in a raw format, and reads them back.


def _put(df: DataFrame, path: str, sep: str = "|", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header)


def _path(g: PropertyGraph, name: str) -> str:
    return f"{shared_dir(g.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _social_pairs(read: PropertyGraph) -> DataFrame:
    return joins.fetch_property(read.edges("Person", "knows", "Person").select("src", "dst"), read.vertices("Person"), "src", "name")


def _transfers(g: PropertyGraph) -> DataFrame:
    return g.edges("Account", "transfer", "Account").select("src", "dst")


_SOCIAL_PAIRS = sql("SELECT src, dst, substr(name, 1, 16) AS name FROM knows JOIN person ON src = id")


@register("read_ldbc_bi", _SOCIAL_PAIRS)
def _(g):
    path = _path(g, "ldbc-bi")
    _put(g.vertices("Person").select("id", F.col("name").alias("firstName"), F.col("community").alias("LocationCityId")).repartition(3), f"{path}/Person")
    _put(_transfers(g).select(F.lit("x").alias("creationDate"), F.col("src").alias("Person1Id"), F.col("dst").alias("Person2Id")), f"{path}/Person_knows_Person")
    return _social_pairs(readers.ldbc_bi(g.spark, path, dense=False))


@register("read_ldbc_ic", _SOCIAL_PAIRS)
def _(g):
    path = _path(g, "ldbc-ic")
    _put(g.vertices("Person").select("id", F.col("name").alias("firstName"), F.col("community").alias("place")), f"{path}/person_0_0.csv")
    _put(_transfers(g).select("src", "dst", F.lit("x").alias("since")), f"{path}/person_knows_person_0_0.csv")
    return _social_pairs(readers.ldbc_ic(g.spark, path, dense=False))


@register("read_snap_txt", sql("SELECT src, dst FROM knows"))
def _(g):
    path = _path(g, "snap")
    lines = _transfers(g).select(F.concat_ws("\t", "src", "dst").alias("value")).union(g.spark.createDataFrame([("# a comment",), ("",)], "value string"))
    lines.write.text(path)
    return readers.snap_txt(g.spark, path, dense=False).edges("Person", "knows", "Person").select("src", "dst")


@register("read_snap_csv", sql("SELECT src, dst FROM knows"))
def _(g):
    path = _path(g, "snap")
    _put(_transfers(g).toDF("node_1", "node_2"), path, ",")
    return readers.snap_csv(g.spark, path, dense=False).edges("Person", "knows", "Person").select("src", "dst")


@register("read_rabo", sql("SELECT a.rank AS src, b.rank AS dst FROM transfer JOIN n a ON src = a.id JOIN n b ON dst = b.id", "n AS (SELECT id, row_number() OVER (ORDER BY 'NL' || id::VARCHAR) - 1 AS rank FROM (SELECT src AS id FROM transfer UNION SELECT dst FROM transfer))"))
def _(g):
    path, name = _path(g, "rabo"), lambda c: F.concat(F.lit("NL"), F.col(c))
    _put(_transfers(g).select(name("src").alias("start_id"), name("dst").alias("end_id"), F.lit(1).alias("count")), path, ";")
    return readers.rabo(g.spark, path).edges("Account", "transfer", "Account").select("src", "dst")


def _finbench(g: PropertyGraph) -> str:
    path = _path(g, "finbench")
    ends = {"PersonOwnAccount": ("Owner", "own", "personId", "accountId"), "AccountTransferAccount": ("Account", "transfer", "fromId", "toId"), "AccountWithdrawAccount": ("Account", "withdraw", "fromId", "toId"), "MediumSignInAccount": ("Medium", "signIn", "mediumId", "accountId"), "LoanDepositAccount": ("Loan", "deposit", "loanId", "accountId")}
    for file, (label, kind, a, b) in ends.items():
        _put(g.edges(label, kind, "Account").select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(1).alias("amount")), f"{path}/{file}.csv")
    for file, label, key in (("Person", "Owner", "personId"), ("Account", "Account", "accountId"), ("Medium", "Medium", "mediumId"), ("Loan", "Loan", "loanId")):
        _put(g.vertices(label).withColumnRenamed("id", key), f"{path}/{file}.csv")
    return path


@register("read_finbench_transfers", sql("SELECT src, dst FROM transfer"))
def _(g):
    path = _path(g, "finbench")
    _put(_transfers(g).select(F.col("src").alias("fromId"), F.col("dst").alias("toId"), F.lit(1).alias("amount")), f"{path}/AccountTransferAccount.csv")
    return readers.finbench_transfers(g.spark, path, dense=False).edges("Account", "transfer", "Account").select("src", "dst")


_KINDS = ("own", "transfer", "withdraw", "signin", "deposit")
_FINBENCH = " UNION ALL ".join([f"SELECT '{k}' AS kind, src AS a, dst AS b FROM {k}" for k in _KINDS] + ["SELECT 'medium', id, isBlocked::BIGINT FROM medium", "SELECT 'loan', id, balance FROM loan", "SELECT 'account', id, 0 FROM account", "SELECT 'person', n_nationkey::BIGINT, 0 FROM nation"])


@register("read_finbench", sql(_FINBENCH))
def _(g):
    read = readers.finbench(g.spark, _finbench(g), dense=False)
    parts = [read.edges("Person" if e.type == "own" else e.source, e.type, e.target).select(F.lit(e.type.lower()).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")) for e in read.schema.edges]
    for label, prop in (("Medium", F.col("isBlocked")), ("Loan", F.col("balance")), ("Account", F.lit(0)), ("Person", F.lit(0))):
        parts.append(read.vertices(label).select(F.lit(label.lower()).alias("kind"), F.col("id").alias("a"), prop.cast("long").alias("b")))
    return joins.reduce(DataFrame.unionByName, parts)


@register("read_finbench_params", sql("SELECT 'tcr' || k AS query, id AS id1, CASE WHEN k = 3 THEN id + 1 END AS id2 FROM account, (VALUES (1), (2), (3), (6), (8)) q(k)"))
def _(g):
    path = _path(g, "params")
    for k in (1, 2, 3, 6, 8):
        _put(g.vertices("Account").select("id", (F.col("id") + 1).alias("id2"), F.lit(0).alias("start"), F.lit(9).alias("end")), f"{path}/complex_{k}_param.csv")
    rows = [df.select(F.lit(q).alias("query"), F.col(df.columns[0]).alias("id1"), (F.col("id2") if "id2" in df.columns else F.lit(None).cast("long")).alias("id2")) for q, df in readers.finbench_params(g.spark, path).items()]
    return joins.reduce(DataFrame.unionByName, rows)


def _as_social(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(g.spark, readers.SOCIAL, {"Person": g.vertices("Person")}, {"Person_knows_Person": g.edges("Person", "knows", "Person")})


@register("save_and_load", sql("SELECT src, dst, name FROM knows JOIN person ON src = id"))
def _(g):
    path = _path(g, "native")
    sinks.native(_as_social(g), path)
    return _social_pairs(PropertyGraph.load(g.spark, path))


@register("write_csv", sql("SELECT src::VARCHAR || ',' || dst AS line FROM knows UNION ALL SELECT id || ',' || name || ',' || community FROM person"))
def _(g):
    path = _path(g, "csv")
    sinks.csv(_as_social(g), path)
    return g.spark.read.text([f"{path}/Person", f"{path}/Person_knows_Person"]).withColumnRenamed("value", "line")


@register("write_label_graph", sql("SELECT src::VARCHAR || ' ' || dst AS line FROM knows UNION ALL SELECT id || ' ' || community FROM person"))
def _(g):
    path = _path(g, "label")
    sinks.label_graph(_as_social(g), path)
    return g.spark.read.text([f"{path}/edges", f"{path}/vertices"]).withColumnRenamed("value", "line")


@register("write_json", sql("""SELECT '[' || id || ',"' || name || '",' || CASE WHEN community = 0 THEN 'null' ELSE community::VARCHAR END || ']' AS line FROM person"""))
def _(g):
    path = _path(g, "json")
    sinks.json_results(g.vertices("Person").select("id", "name", F.nullif(F.col("community"), F.lit(0)).alias("community")), path)
    return g.spark.read.text(f"{path}/results").withColumnRenamed("value", "line")
