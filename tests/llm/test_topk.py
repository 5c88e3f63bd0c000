import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import topk


def brute(rows, k, is_query):
    ids = np.array([i for i, _ in rows])
    vecs = np.floor(np.array([v for _, v in rows], float) * 256).astype(np.int64).astype(object)
    top = 2**63 - 1
    out = []
    for i, q in zip(ids, vecs, strict=True):
        if is_query(i):
            s = sorted((-max(-top, min(top, int(q @ v))), int(j)) for j, v in zip(ids, vecs, strict=True) if j != i)[:k]
            out += [(int(i), r + 1, j, -p) for r, (p, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("annulus", "block_bytes"), [(256, 1 << 24), (8, 64)])
def test_search_equals_brute_force(spark, monkeypatch, annulus, block_bytes):
    # 8 rows a block: cells of several rings, and rings of several blocks where many vectors are the same
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(topk, "PIVOTS", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    good = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).astype(float).tolist()) for i in range(600)]
    good += [(1000 + i, good[7][1]) for i in range(200)]  # ties
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, q string, Cell int")
    got = topk.search(topk.quantised(df), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute(good, 5, lambda i: i % 10 == 0)


def test_bounds_leave_out_blocks(spark, monkeypatch):
    """Queries see few of the blocks of clustered vectors, and still find what all products say."""
    monkeypatch.setattr(topk, "PIVOTS", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6))
    good = [(i, (centres[i % 40] / np.linalg.norm(centres[i % 40]) + rng.normal(size=6) * 0.01).tolist()) for i in range(3000)]
    rows = topk.quantised(spark.createDataFrame(good, "vec_id long, embedding array<double>"))
    index = topk.Index(rows, F.col("vec_id") % 50 == 0, 5)
    asked = index.asked(index.home()).count()
    share = asked / (60 * (sum(r[5] for r in index.rings) - 1))
    print(f"share of the other blocks that a query visits: {share:.3f}")
    assert share < 0.3
    assert sorted(map(tuple, topk.search(rows, F.col("vec_id") % 50 == 0, 5).collect())) == brute(good, 5, lambda i: i % 50 == 0)


def test_annuli_are_passed_over():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(size=(3000, 4)) * 5 + 60 * rng.integers(-3, 4, (3000, 1))).astype(np.int64)
    m2 = float((x**2).sum(1).max())
    flat = topk.Index._lifted(x.astype(float), m2)
    pivot = topk.fit_pivots(flat[:500], 1)
    block = topk.Block(np.arange(3000), x, topk.to_pivots(flat, pivot)[:, 0])
    s, i = block.search(np.array([-1]), x[:1], topk.to_pivots(x[:1].astype(float), pivot)[:, 0], np.array([np.inf]), 3, m2)
    order = np.lexsort((np.arange(3000), -(x @ x[0])))[:3]
    assert i[0].tolist() == order.tolist() and s[0].tolist() == (x @ x[0])[order].tolist()


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e8])
def test_large_components_and_mixed_lengths(spark, scale):
    """Products beyond doubles, and beyond 32 bits a component, are exact; shorter vectors count as filled up."""
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=3 + i % 3) * scale).tolist()) for i in range(120)]
    padded = [(i, v + [0.0] * (5 - len(v))) for i, v in good]
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    got = topk.search(topk.quantised(df), F.col("vec_id") % 7 == 0, 4)
    assert sorted(map(tuple, got.collect())) == brute(padded, 4, lambda i: i % 7 == 0)


def test_products_of_any_size():
    x = np.array([[1 << 40, 3], [-(1 << 40), 5], [1 << 20, -7]])
    want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x] for p in x]
    top = np.iinfo(np.int64).max
    assert topk.products(x, x, float((x.astype(float) ** 2).sum(1).max())).tolist() == [[max(-top, min(top, s)) for s in row] for row in want]


def test_few_rows(spark):
    df = spark.createDataFrame([(50, [0.5, 0.25]), (1, [0.1, 0.2])], "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.search(q, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1)]
    assert topk.search(q.limit(0), F.lit(True)).count() == 0 == topk.search(q, F.lit(False)).count()
