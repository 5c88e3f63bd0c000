"""Exact top-k inner-product search with a pivot-distance index.

Inner products become distances: with M the largest norm and one more
coordinate sqrt(M^2 - |x|^2) for vectors (0 for queries), all vectors lie on a
sphere and d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the
nearest neighbours. Every vector is keyed by (nearest pivot, distance to it), and the
index is dealt by that key: a cell is cut into rings of about equal size by
distance, and a ring into blocks of bounded bytes where it is larger. In a block, vectors
are sorted by distance and cut into annuli.

A query first searches the block it lies in itself, which gives it a bound, the k-th best
distance there. It is then sent only to blocks whose ring [lo, hi] the triangle
inequality leaves: max(d(q, p) - hi, lo - d(q, p)) within the bound; and there expands
annuli from the nearest on until that inequality passes over all others.

Pivots are fitted on a bounded sample (``SAMPLE`` rows by hash); every row is
indexed and the search is exact, whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.llm.common import tasks_for, written

SAMPLE = 4096
#: Pivots, and rings in a cell at most: together they bound the table that is broadcast.
PIVOTS, RINGS = 64, 64
#: Rows in a sorted annulus, and bytes of vectors in a block.
ANNULUS, BLOCK_BYTES = 256, 16 << 20
NONE = np.iinfo(np.int64).min
#: Rounding of distances, as a share of the largest norm; bounds give way by so much.
SLACK = 4e-6


def fit_pivots(sample: np.ndarray, k: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Lloyd rounds from evenly spaced rows; deterministic."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    pivots = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].astype(float)
    for _ in range(rounds):
        near = ((pivots**2).sum(1) - 2 * sample @ pivots.T).argmin(1)
        for j in range(len(pivots)):
            if (near == j).any():
                pivots[j] = sample[near == j].mean(0)
    return pivots


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer vectors; ``most`` bounds their size. Such
    as 64 bits cannot hold count as the nearest number that they can."""
    if most < 2.0**53:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Block:
    """Vectors of one block, sorted by distance to the pivot."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, r: np.ndarray):
        order = np.lexsort((ids, r))
        self.ids, self.vecs, self.r = ids[order], vecs[order], r[order]

    def search(self, qid: np.ndarray, q: np.ndarray, to_pivot: np.ndarray, worst: np.ndarray, k: int, m2: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k columns a query, best first, missing ones as NONE; whatever can be
        within ``worst``, the distances from which on others are known to be better, is found."""
        best_s, best_i = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
        q2, slack = (q.astype(float) ** 2).sum(1), SLACK * np.sqrt(m2)
        jobs = []
        for a in range(0, len(self.ids), ANNULUS):
            b = min(a + ANNULUS, len(self.ids))
            bound = np.maximum(np.maximum(to_pivot - self.r[b - 1], self.r[a] - to_pivot), 0) - slack
            jobs.append((bound.min(), a, b, bound))
        for _, a, b, bound in sorted(jobs, key=lambda j: (j[0], j[1])):
            # equal bounds are still searched, for ties
            live = np.flatnonzero(bound <= np.minimum(worst, reach(best_s[:, -1], q2, m2)) + slack)
            if not len(live):
                continue
            s = products(q[live], self.vecs[a:b], m2)
            i = np.broadcast_to(self.ids[a:b], s.shape).copy()
            own = i == qid[live, None]
            s[own], i[own] = NONE, np.iinfo(np.int64).max
            s, i = np.concatenate((best_s[live], s), 1), np.concatenate((best_i[live], i), 1)
            top = _top(s, i, k)
            best_s[live], best_i[live] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best_s, best_i


def reach(score: np.ndarray, q2: np.ndarray, m2: float) -> np.ndarray:
    """Distance of a vector with this score; boundless where there is none, or 64 bits did not hold it."""
    return np.where(score <= NONE + 1, np.inf, np.sqrt(np.maximum(q2 + m2 - 2.0 * score, 0)))


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots[:, : x.shape[1]].T + (pivots**2).sum(1), 0))


def _top(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best by (score down, id up) in each row."""
    return np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x) with x as double. Vectors
    that are null, empty, or hold a null or non-finite component take no part."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ok & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A matrix of lists of any lengths up to ``dim``, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = column.flatten().to_numpy()
    return out


KEY = ["cell", "ring", "block"]


class Index:
    """The index of ``rows`` (vec_id long, v array<long>) as a written table, and its queries.

    The driver holds the pivots and one line a ring, PIVOTS x RINGS at most."""

    def __init__(self, rows: DataFrame, is_query: Column, k: int):
        self.spark, self.k = rows.sparkSession, k
        length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
        self.n, dim, m2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
        if not self.n:
            return
        self.dim, self.m2 = dim, float(m2)
        self.kind = "<i4" if self.m2 < 2.0**61 else "<i8"  # a component is within the root of it
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        sample = _vectors(picked, dim).astype(float)
        self.pivots = fit_pivots(self._lifted(sample, self.m2))
        keyed = written(rows.select("vec_id", "v", is_query.alias("q")).mapInArrow(self._keyed(), "vec_id long, cell int, r double, data binary, q boolean"), "keyed")
        per_block = max(ANNULUS, BLOCK_BYTES // (8 * dim))
        rings = min(RINGS, max(1, round(self.n / len(self.pivots) / per_block)))
        cuts = keyed.groupBy("cell").agg(F.percentile_approx("r", F.array(*[F.lit(j / rings) for j in range(1, rings)]), 1000).alias("cuts")) if rings > 1 else keyed.select("cell", F.array().cast("array<double>").alias("cuts")).distinct()
        # a row a pivot: a proven bound
        ring = keyed.join(F.broadcast(cuts), "cell").select("vec_id", "cell", F.size(F.filter("cuts", lambda c: c < F.col("r"))).alias("ring"), "r", "data", "q")
        #: (cell, ring, rows, least r, largest r, blocks)
        self.rings = [(*r, -(-r["n"] // per_block)) for r in ring.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("r"), F.max("r")).orderBy("cell", "ring").collect()]
        blocks = self.spark.createDataFrame([(c, g, b) for c, g, _, _, _, b in self.rings], "cell int, ring int, blocks long")
        self.rows = ring.join(F.broadcast(blocks), ["cell", "ring"]).select("vec_id", "cell", "ring", F.pmod(F.xxhash64("vec_id", "data"), "blocks").cast("int").alias("block"), "r", "data", "q")

    @staticmethod
    def _lifted(x: np.ndarray, m2: float) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0))[:, None]), 1)

    def _keyed(self):
        pivots, m2, dim, kind, lifted = self.pivots, self.m2, self.dim, self.kind, self._lifted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _vectors(batch.column(1), dim)
                    d = to_pivots(lifted(v.astype(float), m2), pivots)
                    cell = d.argmin(1)
                    data = pa.array([p.tobytes() for p in v.astype(kind)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(d.min(1)), data, batch.column(2)], ["vec_id", "cell", "r", "data", "q"])

        return run

    def home(self) -> DataFrame:
        """A written table: each query with the k best of its own block. (query_id, cell, ring, block, data, scores, ids)."""
        kind, dim, k, m2, pivots = self.kind, self.dim, self.k, self.m2, self.pivots

        def find(block: pa.Table) -> Iterator[pa.RecordBatch]:
            q = np.flatnonzero(block.column("q").to_numpy())
            if not len(q):
                return
            ids, vecs, data = _block(block, dim, kind)
            index = Block(ids, vecs, block.column("r").to_numpy())
            cell = int(block.column("cell")[0].as_py())
            for a in range(0, len(q), 1024):
                at = q[a : a + 1024]
                to_pivot = to_pivots(vecs[at].astype(float), pivots[cell : cell + 1])[:, 0]
                s, i = index.search(ids[at], vecs[at], to_pivot, np.full(len(at), np.inf), k, m2)
                got = s > NONE
                lists = [pa.array([x[g].tolist() for x, g in zip(m, got, strict=True)], pa.list_(pa.int64())) for m in (s, i)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *[block.column(c).take(pa.array(at)).combine_chunks() for c in KEY], pa.array([data[x] for x in at], pa.binary()), *lists], ["query_id", *KEY, "data", "scores", "ids"])

        rows = self._dealt(self.rows.select(*KEY, "vec_id", "r", "data", "q")).sortWithinPartitions(*KEY)
        return written(rows.mapInArrow(_by_block(find), "query_id long, cell int, ring int, block int, data binary, scores array<long>, ids array<long>"), "home")

    def asked(self, home: DataFrame) -> DataFrame:
        """A row for each query and block besides its own that its bound leaves."""
        rings, kind, dim, k, m2, pivots = self.rings, self.kind, self.dim, self.k, self.m2, self.pivots
        cell, ring, blocks = (np.array([r[c] for r in rings], np.int32) for c in (0, 1, 5))
        lo, hi = (np.array([r[c] for r in rings], float) for c in (3, 4))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slack = SLACK * np.sqrt(m2)
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    data = part.column("data").to_pylist()
                    x = np.frombuffer(b"".join(data), kind).reshape(-1, dim).astype(float)
                    kth = np.array([s[k - 1] if len(s) >= k else NONE for s in part.column("scores").to_pylist()])
                    worst = reach(kth, (x**2).sum(1), m2)
                    d = to_pivots(x, pivots)[:, cell]
                    row, at = np.nonzero(np.maximum(np.maximum(d - hi, lo - d), 0) - slack <= worst[:, None] + slack)
                    row, at, block = np.repeat(row, blocks[at]), np.repeat(at, blocks[at]), np.concatenate([np.arange(b) for b in blocks[at]] or [at])
                    home_ = [part.column(c).to_numpy()[row] for c in KEY]
                    other = (home_[0] != cell[at]) | (home_[1] != ring[at]) | (home_[2] != block)
                    row, at, block = row[other], at[other], block[other].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(ring[at]), pa.array(block), part.column("query_id").take(pa.array(row)), pa.array(worst[row]), pa.array([data[i] for i in row], pa.binary())], [*KEY, "query_id", "worst", "data"])

        return home.select("query_id", *KEY, "data", "scores").mapInArrow(run, "cell int, ring int, block int, query_id long, worst double, data binary")

    def visit(self, asked: DataFrame) -> DataFrame:
        """A written table (query_id, vec_id, score) of what the asked blocks have within the bounds. A
        block's vectors come first and are kept, its queries pass by in batches."""
        kind, dim, k, m2, pivots = self.kind, self.dim, self.k, self.m2, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, index = None, [], None
            for batch in batches:
                for t in _runs(batch):
                    here = tuple(t.column(c)[0].as_py() for c in KEY)
                    if here != key:
                        key, held, index = here, [], None
                    asks = t.column("asks").to_numpy(zero_copy_only=False)
                    n = int(np.searchsorted(asks, True))
                    if n:
                        held.append(t.slice(0, n))
                    if n == t.num_rows or not held:
                        continue
                    if index is None:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        ids, vecs, _ = _block(whole, dim, kind)
                        index = Block(ids, vecs, whole.column("r").to_numpy())
                    for a in range(n, t.num_rows, 1024):
                        part = t.slice(a, 1024)
                        qid, q, _ = _block(part, dim, kind)
                        to_pivot = to_pivots(q.astype(float), pivots[key[0] : key[0] + 1])[:, 0]
                        s, i = index.search(qid, q, to_pivot, part.column("r").to_numpy(), k, m2)
                        got = s > NONE
                        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], s.shape)[got]), pa.array(i[got]), pa.array(s[got])], ["query_id", "vec_id", "score"])

        index = self.rows.select(*KEY, "vec_id", "r", "data", F.lit(False).alias("asks"))
        rows = self._dealt(index.union(asked.select(*KEY, "query_id", "worst", "data", F.lit(True))))
        return written(rows.sortWithinPartitions(*KEY, "asks").mapInArrow(run, "query_id long, vec_id long, score long"), "visited")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks_for(self.spark, self.n * (8 * self.dim + 32)), *KEY)


def _block(t: pa.Table | pa.RecordBatch, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = t.column("data").to_pylist()
    return t.column("vec_id").to_numpy(), np.frombuffer(b"".join(data), kind).reshape(-1, dim).astype(np.int64), data


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch that are of one block."""
    if not batch.num_rows:
        return
    key = np.stack([batch.column(c).to_numpy() for c in KEY])
    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


def _by_block(find):
    """``find`` for each whole block of rows that come by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for t in _runs(batch):
                here = tuple(t.column(c)[0].as_py() for c in KEY)
                if here != key and held:
                    yield from find(pa.Table.from_batches(held))
                    held = []
                key = here
                held.append(t)
        if held:
            yield from find(pa.Table.from_batches(held))

    return run


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """Top ``k`` of every query row among all other rows: (query_id, rank, vec_id, score).

    ``rows`` is (vec_id long, v array<long>). Vectors of unlike length meet as if
    the shorter were filled up with zeros; components may be any long; a product that
    64 bits cannot hold counts as the nearest that they can. A row is a query's own if its
    id is equal. Equal scores go to the smaller id; repeated ids are candidates once
    each. No rows: empty result. Fewer than k candidates: all of them.
    """
    index = Index(rows, is_query, k)
    if not index.n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    home = index.home()
    found = index.visit(index.asked(home))
    near = home.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
