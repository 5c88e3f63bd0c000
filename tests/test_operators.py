import random

import pytest
from pyspark.sql import functions as F

from hopweave.operators import aggregate, expand as ex, joins
from hopweave.queries import QUERIES


@pytest.fixture(scope="module")
def keyed(spark):
    k = [1, 1, 1, 2, 2, 3, 3, 4]
    a = spark.createDataFrame([(i + 1, x) for i, x in enumerate(k)], "a long, k long")
    return a, a.withColumnRenamed("a", "b")


def test_hash_join(keyed):
    a, b = keyed
    out = joins.hash_join(a, b, "k")
    assert out.columns == ["a", "k", "b"] and out.count() == 18
    assert joins.hash_join_count(a, b, "k").first()[0] == 18
    assert joins.hash_join_count(a.limit(0), b, "k").first()[0] == 0
    with pytest.raises(ValueError):
        joins.hash_join(a, a, "k")


def test_mintersect(spark):
    k = [1, 1, 1, 2, 2, 3, 3, 4]
    frame = lambda x, y: spark.createDataFrame([(i + 1, v) for i, v in enumerate(k)], f"{x} long, {y} long")
    base, e1, e2 = frame("a", "b"), frame("a", "c"), frame("b", "c").select("c", "b")
    assert sorted(map(tuple, joins.mintersect(base, "c", [e1, e2]).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    # the base is a bag, edges are sets
    assert joins.mintersect_count(base.union(base), "c", [e1.union(e1), e2.union(e2)]).first()[0] == 6


def test_semi_join(spark):
    a = spark.createDataFrame(list(zip(range(1, 9), [1, 6, 7, 8, 2, 3, 3, 4], strict=True)), "a long, k long")
    b = spark.createDataFrame(list(zip(range(1, 9), [1, 1, 1, 2, 2, 7, 8, 4], strict=True)), "b long, k long")
    assert {r.a for r in joins.semi_join(a, b, ["k"]).collect()} == {1, 3, 4, 5, 8}
    assert joins.semi_join_count(a, b, ["k"]).first()[0] == 5


def test_reorder_transpose_and_merge(spark):
    t = spark.createDataFrame(list(zip([1, 5, 2, 3, 7, 1, 4, 3], [1, 1, 1, 2, 2, 3, 3, 4], strict=True)), "a long, k long")
    assert [r.a for r in joins.reorder(t, "a").collect()] == [1, 1, 2, 3, 3, 4, 5, 7]
    assert joins.transpose(t).columns == ["k", "a"]
    at = lambda n: spark.range(n).withColumnRenamed("id", "i")
    assert joins.zip_merge(at(4).withColumn("x", F.col("i") * 2), at(4).withColumn("y", -F.col("i")), "i").count() == 4
    with pytest.raises(Exception, match="unequal"):
        joins.zip_merge(at(4).withColumn("x", F.lit(1)), at(5).withColumn("y", F.lit(1)), "i").collect()


def walks(edges, starts, k_min, k_max, path):
    """(s, v, k) by brute force; with "shortest" each pair at its least k only."""
    out, layer, seen = [], {(s, s) for s in starts}, {(s, s) for s in starts}
    for k in range(k_max + 1):
        if k:
            layer = {(s, d) for s, v in layer for u, d in edges if u == v}
            if path == "shortest":
                layer -= seen
                seen |= layer
        out += [(s, v, k) for s, v in layer if k >= k_min]
    return out


@pytest.mark.parametrize("strategy", ["pairs", "bits"])
@pytest.mark.parametrize(("path", "k_min"), [("any", 0), ("any", 2), ("shortest", 0), ("shortest", 1)])
def test_expand_equals_brute_force(spark, strategy, path, k_min):
    rng = random.Random(len(strategy) + k_min)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(150)] + [(1, 1), (2, 1)]
    starts = [*range(75), 3, 3, 400]
    e = spark.createDataFrame(edges, "src long, dst long")
    s = spark.createDataFrame([(x, "dropped") for x in starts] + [(None, "x")], "a long, extra string")
    want = walks(edges, set(starts), k_min, 3, path)
    times = lambda x: starts.count(x)
    bag = lambda rows: sorted(r for r in rows for _ in range(times(r[0])))
    got = ex.expand(s, "a", "b", e, k_min, 3, path, "all", strategy)
    assert got.columns == ["a", "b", "distance"]
    assert sorted(map(tuple, got.collect())) == bag(want)
    got = ex.expand(s, "a", "b", e, k_min, 3, path, None, strategy)
    assert sorted(map(tuple, got.collect())) == bag({(x, y) for x, y, _ in want})
    least = {}
    for x, y, k in sorted(want, key=lambda r: -r[2]):
        least[x, y] = k
    got = ex.expand(s, "a", "b", e, k_min, 3, path, "min", strategy)
    assert sorted(map(tuple, got.collect())) == bag((x, y, k) for (x, y), k in least.items())


def test_bit_counts_and_ends(spark):
    edges = [(i, (i * 7 + 3) % 200) for i in range(200)] + [(i, 5) for i in range(0, 200, 3)]
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.range(150).toDF("a")
    got = {r.v: r.n for r in ex.bit_counts(s, "a", e, 1, 2).collect()}
    want = {}
    for x, y in {(x, y) for x, y, _ in walks(edges, range(150), 1, 2, "any")}:
        want[y] = want.get(y, 0) + 1
    assert got == want
    assert ex.expand(s.limit(0), "a", "b", e, 0, 2).count() == 0
    assert ex.expand(s, "a", "b", e.limit(0), 1, 2, strategy="bits").count() == 0


def test_find_shortest(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (9, 1)], "src long, dst long")
    pairs = [(1, 3), (1, 3), (4, 1), (5, 5), (9, 4), (1, None), (77, 78)]
    got = ex.find_shortest(spark.createDataFrame(pairs, "a long, b long"), "a", "b", e).collect()
    assert sorted((r.a, r.b or -1, r.distance) for r in got) == [(1, -1, -1), (1, 3, 2), (1, 3, 2), (4, 1, -1), (5, 5, 0), (9, 4, 2), (77, 78, -1)]


def test_counts(spark):
    p = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "a long, b long")
    u = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    assert [tuple(r) for r in aggregate.column_count(p, "b", u, "desc").collect()] == [(10, 2), (11, 1), (12, 0)]
    assert sorted(r.b for r in aggregate.row_or(p, "b").collect()) == [10, 11]
    assert aggregate.group_by(p, "a", "b").columns == ["a", "SUM(b)"]
    assert dict(aggregate.group_by(p, "a", "b", "avg", "m").collect()) == {1: 10.5, 2: 10.0}
    with pytest.raises(ValueError):
        aggregate.group_by(p, "a", "b", "median")


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "s long, t long")
    b = spark.createDataFrame([(1, 2), (2, 2)], "s long, t long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(joins.union_pairs(a, b)) == [(1, 1), (1, 2), (2, 2)]
    assert rows(joins.difference(a, b)) == [(1, 1)]
    assert rows(joins.intersection(a, b)) == [(1, 2)] and joins.intersects(a, b)
    assert rows(joins.complement(a, spark.createDataFrame([(1,)], "s long"), spark.range(4).toDF("t"))) == [(1, 0), (1, 3)]
    parts = joins.split_by(b, "s")
    assert {k: rows(d) for k, d in parts.items()} == {1: [(2,)], 2: [(2,)]}
    left, right = a.select(F.col("s").alias("x"), F.col("t").alias("m")), b.select(F.col("s").alias("y"), F.col("t").alias("m"))
    assert rows(joins.boolean_product(left, right, "m")) == [(1, 1), (1, 2)]


def test_ranked_queries_return_all_rows(spark):
    d = "/root/testdata/sf0.01"
    people = [(r.c_custkey, r.c_nationkey) for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    got = [(r.id, r.community, r["rank"]) for r in QUERIES["reorder"](spark, d).collect()]
    want = sorted(people, key=lambda p: (-p[1], p[0]))
    assert got == [(i, c, k) for k, (i, c) in enumerate(want, 1)]
    got = [(r.b, r["count"], r["rank"]) for r in QUERIES["column_count_asc"](spark, d).collect()]
    want = sorted(((r["count"], r.b) for r in QUERIES["column_count"](spark, d).collect()))
    assert len(want) == len(people) and got == [(b, n, k) for k, (n, b) in enumerate(want, 1)]


def test_neighbour_queries_start_from_all_accounts(spark):
    d = "/root/testdata/sf0.001"
    orders = sorted((r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").collect())
    got = [tuple(r) for r in QUERIES["expand_neighbor_bwd"](spark, d).select("a", "b").collect()]
    assert sorted(got) == sorted({(c, o) for o, c in orders})
    got = [tuple(r) for r in QUERIES["expand_neighbor_distance"](spark, d).select("a", "b", "distance").collect()]
    assert sorted(got) == sorted({(x[1], y[1], 1) for x, y in zip(orders[:-1], orders[1:], strict=True)})


@pytest.mark.parametrize("strategy", ["pairs", "bits"])
@pytest.mark.parametrize("path", ["any", "shortest"])
def test_targets_are_those_of_a_filter_behind(spark, strategy, path):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(70)], "src long, dst long")
    starts, ends = spark.range(8).toDF("a"), spark.createDataFrame([(i,) for i in (1, 1, 5, 9, 200)], "id long")
    for k_min, k_max in ((0, 0), (0, 3), (2, 3)):
        whole = ex.expand(starts, "a", "b", edges, k_min, k_max, path, "all", strategy)
        got = ex.expand(starts, "a", "b", edges, k_min, k_max, path, "all", strategy, targets=ends)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in whole.collect() if r.b in (1, 5, 9))


def test_reached_is_every_target(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (1,), (7,), (None,)], "a long")
    want = {r.b for r in ex.expand(starts, "a", "b", edges, 0, 3, "shortest").collect()}
    got = [r.v for r in ex.reached(starts, "a", edges, 3).collect()]
    assert set(got) == want and len(got) == len(want)


def test_find_shortest_equals_breadth_first(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(i, i + 1) for i in range(100, 120)]
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(3, 3), (100, 107), (100, 108), (100, 120), (107, 100), (3, 999)]

    def hops(s, t):
        seen, front, k = {s}, {s}, 0
        while front and k <= 7:
            if t in front:
                return k
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            k += 1
        return -1

    got = ex.find_shortest(spark.createDataFrame(pairs, "a long, b long"), "a", "b", spark.createDataFrame(edges, "src long, dst long").distinct(), 7)
    assert sorted(map(tuple, got.collect())) == sorted((s, t, hops(s, t)) for s, t in pairs)


def test_an_aggregate_of_the_users_own(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 4)], "k long, x long")
    assert sorted(map(tuple, aggregate.group_by(df, "k", "x", lambda c: F.max(c) - F.min(c), "spread").collect())) == [(1, 4), (2, 0)]


@pytest.mark.parametrize("cast", ["long", "string"])
def test_complement_lists_its_product_last(spark, monkeypatch, cast):
    monkeypatch.setattr(joins, "BLOCK", 8)
    rng = random.Random(4)
    pairs = [(rng.randrange(12), rng.randrange(50)) for _ in range(200)] + [(2, i) for i in range(50)] + [(None, 3), (3, None)]
    rows, columns = [*range(1, 10), 3, None], [*range(5, 45), 5, None]
    typed = lambda d: d.select(*[F.col(c).cast(cast) for c in d.columns])
    frame = lambda x, name: typed(spark.createDataFrame([(i,) for i in x], f"{name} long"))
    got = joins.complement(typed(spark.createDataFrame(pairs, "a long, b long")), frame(rows, "s"), frame(columns, "t"))
    known = {p for p in pairs if None not in p}
    want = {(s, t) for s in rows for t in columns} - known
    out = [tuple(None if x is None else int(x) for x in r) for r in got.collect()]
    assert got.columns == ["s", "t"] and len(out) == len(want) and set(out) == want
    # nothing is shuffled after the pairs are listed
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]


@pytest.mark.parametrize("path", ["any", "shortest"])
def test_bit_counts_never_store_the_last_layer(spark, monkeypatch, path):
    rng = random.Random(11)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)]
    starts = list(range(100))
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in [*starts, 4, None]], "a long")
    kept, real = [], ex.counted
    monkeypatch.setattr(ex, "counted", lambda df, name="step": kept.append(name) or real(df, name))
    for k_min, k_max in ((0, 0), (0, 1), (0, 3), (2, 3), (3, 3)):
        kept.clear()
        got = {r.v: r.n for r in ex.bit_counts(s, "a", e, k_min, k_max, path).collect()}
        want = {}
        for _, y in {(x, y) for x, y, _ in walks(edges, starts, k_min, k_max, path)}:
            want[y] = want.get(y, 0) + 1
        assert got == want
        assert kept.count("layer") == max(k_max - 1, 0)
