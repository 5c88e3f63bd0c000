"""Toxicity by a classifier chain over hashed word features.

The categories are predicted one after the other by linear (logistic) models; a
later model also reads the earlier categories' probabilities. While training,
these come from out-of-fold predictions: for each fold, features are chosen and a
model is fitted on the other folds alone, so a later model never sees an earlier
one's answer for a row that had any part in it. Rows of equal features, and so all
copies of a text, are in one fold. ``labels`` has one toxicity category and a quality
flag; the chain is ("low_quality", "toxic").

A document's features are which words and word beginnings it has (presence,
whole text): beginnings catch the inflected and compounded forms. A model reads the
``FEATURES`` that tell most, its documented size; they are counted and ranked in Spark.

Fitted on a bounded sample: the ``TRAIN_ROWS`` labelled rows that come first by a
hash of their id. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.common import LOWER, chunks, forget, joined, prefix_hash, span_hash, written

CHAIN = ("low_quality", "toxic")
TRAIN_ROWS, FOLDS = 8000, 5
#: Size of a model: the features it reads at most.
FEATURES = 192
#: Lengths in bytes of the word beginnings; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 0)
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Probability from which a document counts as toxic.
REJECT = 0.3
PASS = 1 << 17
#: What ends a word: all bytes but ASCII letters, digits and those of longer characters.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs, distinct or not, of whole texts, a bounded pass at a time."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for lo, hi in chunks([len(r) for r in raw], PASS):
        data, at = joined(raw[lo:hi])
        gap = np.concatenate(([True], _GAP[data], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        a, b = edge[0::2], edge[1::2]
        row = np.searchsorted(at, a, "right") - 1 + lo
        prefix = prefix_hash(LOWER[data])
        for k in BEGINNINGS:
            long = b - a >= k
            s = a[long]
            h = span_hash(prefix, s, s + k if k else b[long])
            yield row[long], h ^ np.uint64(k)


@dataclass
class Link:
    """A linear model over selected features and the probabilities before it."""

    at: np.ndarray
    weight: np.ndarray
    chained: np.ndarray
    bias: float

    def score(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + before @ self.chained + self.bias, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last column is the bias and not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """All links; ``known`` are the features that any of them reads, sorted.

    ``x``: which row has which known feature; ``chosen``: for each category the
    features to read after training on all rows, and on those outside fold 0, 1, ..."""

    def __init__(self, known: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, chosen: list[list[np.ndarray]]):
        self.known, n = known, len(labels)
        self.links: list[Link] = []
        before = np.zeros((n, 0))
        for c, (all_, *others) in enumerate(chosen):
            self.links.append(self._fitted(x, before, labels[:, c], all_))
            if c + 1 < len(chosen):  # the last link's are read by no other
                out = np.zeros(n)
                for f, names in enumerate(others):
                    if (fold == f).any():
                        link = self._fitted(x[fold != f], before[fold != f], labels[fold != f, c], names)
                        out[fold == f] = link.score(x[fold == f][:, link.at].astype(float), before[fold == f])
                before = np.concatenate((before, out[:, None]), 1)
        #: out-of-fold probabilities that later links were trained with, and the labels in the same order
        self.out_of_fold, self.labels = before, labels

    def _fitted(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, names: np.ndarray) -> Link:
        at = np.searchsorted(self.known, names)
        return self._link(at, logistic(np.concatenate((x[:, at], before, np.ones((len(y), 1))), 1), y), before.shape[1])

    @staticmethod
    def _link(at: np.ndarray, w: np.ndarray, chained: int) -> Link:
        return Link(at, w[: len(at)], w[len(at) : len(at) + chained], float(w[-1]))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a column for each category of the chain."""
        x = np.zeros((len(texts), len(self.known)), np.float32)
        if len(self.known):
            # a small table by the low bits tells most features apart from the known ones at once
            near = np.zeros(1 << 16, bool)
            near[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
            for row, h in features(texts):
                maybe = np.flatnonzero(near[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
                hit = self.known[at] == h[maybe]
                x[row[maybe[hit]], at[hit]] = 1
        before = np.zeros((len(texts), 0))
        for link in self.links:
            before = np.concatenate((before, link.score(x[:, link.at], before)[:, None]), 1)
        return before


def fit(docs: DataFrame, labels: DataFrame, targets: list[Column], train_rows: int = TRAIN_ROWS) -> Chain:
    """``targets``: 0/1 columns over ``labels``, one for each category in the chain's order.

    Rows with a null id, text or target are not learned from. A label row that is
    repeated counts as often as it stands, up to the sample's bound.
    """
    ys = [f"y{i}" for i in range(len(targets))]
    picked = labels.select(F.col("doc_id").alias("label"), *[t.cast("int").alias(y) for t, y in zip(targets, ys, strict=True)]).dropna()
    picked = picked.orderBy(F.xxhash64("label"), *picked.columns).limit(train_rows)
    # at most ``train_rows`` rows of integers: a proven bound for the broadcast
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label")).select("text", F.array(*ys).alias("y"), F.col("label").cast("string").alias("k"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [set() for _ in range(batch.num_rows)]
            for row, h in features(batch.column(0).to_pylist()):
                key = np.unique(np.stack((row.astype(np.uint64), h)), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
                cut = np.searchsorted(key[0], np.arange(batch.num_rows + 1, dtype=np.uint64))
                for i in range(batch.num_rows):
                    if cut[i] < cut[i + 1]:
                        got[i].update(key[1][cut[i] : cut[i + 1]].tolist())
            packed = [np.array(sorted(g), "<u8").tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["f", "y", "k"])

    found = rows.mapInArrow(seen, "f binary, y array<int>, k string")
    sample = written(found.withColumn("fold", F.pmod(F.xxhash64("f"), F.lit(FOLDS)).cast("int")), "sample")
    sums = [f"{c}_{f}" for f in range(FOLDS) for c in ("n", *ys)]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = [len(f) // 8 for f in raw]
            names, at = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
            y = np.repeat(np.array(batch.column(1).to_pylist(), np.int64).reshape(len(raw), len(ys)), sizes, 0)
            fold = np.repeat(batch.column(2).to_numpy(), sizes)
            out = []
            for f in range(FOLDS):
                here = fold == f
                out.append(np.bincount(at[here], minlength=len(names)))
                out += [np.bincount(at[here], y[here, c], len(names)).astype(np.int64) for c in range(len(ys))]
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *map(pa.array, out)], ["h", *sums])

    total = sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[c]).alias(y) for c, y in enumerate(ys)]).collect()
    by_name = sample.select("f", "y", "fold").mapInArrow(counts, ", ".join(f"{c} long" for c in ("h", *sums))).groupBy("h").agg(*[F.sum(c).alias(c) for c in sums])
    ranks = []
    for c, y in enumerate(ys):
        for out in range(-1, FOLDS):  # -1: no fold is left out
            use = [f for f in range(FOLDS) if f != out]
            n, positive = (sum(r[x] for r in total if r["fold"] in use) for x in ("n", y))
            count, pos = (sum((F.col(f"{x}_{f}") for f in use), F.lit(0)) for x in ("n", y))
            ranks.append(F.struct(F.lit(c).alias("c"), F.lit(out).alias("out"), F.when(count >= LEAST_DOCS, departure(count, pos, n, positive)).alias("z")))
    # the driver gets FEATURES rows at most for each category and fold
    told = by_name.select("h", F.explode(F.array(*ranks)).alias("r")).select("h", "r.*").where(F.col("z") >= LEAST_Z)
    best = told.withColumn("rank", F.row_number().over(Window.partitionBy("c", "out").orderBy(F.desc("z"), "h"))).where(F.col("rank") <= FEATURES).select("h", "c", "out").toPandas()
    name = best["h"].to_numpy(np.int64).view(np.uint64)
    chosen = [[np.sort(name[(best["c"] == c) & (best["out"] == out)]) for out in range(-1, FOLDS)] for c in range(len(ys))]
    known = np.unique(name)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.packbits(np.isin(known, np.frombuffer(f, "<u8"))).tobytes() for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.binary()), *batch.columns[1:]], ["f", "y", "fold", "k", "o"])

    # one bit a row and known feature
    got = sample.select("f", "y", "fold", "k", F.md5("f").alias("o")).mapInArrow(narrow, "f binary, y array<int>, fold int, k string, o string").toPandas().sort_values(["k", "o"], ignore_index=True)
    forget(sample)
    x = np.array([np.unpackbits(np.frombuffer(f, np.uint8), count=len(known)) for f in got["f"]], bool).reshape(len(got), len(known))
    labels_ = np.array([list(v) for v in got["y"]], float).reshape(len(got), len(ys))
    return Chain(known, x, labels_, got["fold"].to_numpy(int), chosen)


def departure(count: Column, pos: Column, n: int, positives: int) -> Column:
    """How far a feature's share among positives is from that among negatives, in standard errors;
    ``count`` rows of ``n`` have it, ``pos`` of the ``positives``."""
    n1, n0 = float(max(1, positives)), float(max(1, n - positives))
    share = count / (n1 + n0)
    return F.abs(pos / n1 - (count - pos) / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))


def score(docs: DataFrame, model: Chain, names: tuple[str, ...] = CHAIN) -> DataFrame:
    """``docs`` with ``p_<name>`` double for each category. Null and empty texts
    have no feature and get the models' base rates. All rows stay; columns of
    these names are replaced."""
    added = [f"p_{n}" for n in names]
    keep = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    at = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(a, T.DoubleType()) for a in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, c]) for c in range(p.shape[1])]], [*batch.schema.names, *added])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    return fit(docs, labels, [F.col("quality") == 0, F.col("toxic") == 1])


def rejected(text: Column, p_toxic: Column) -> Column:
    """Whether a document counts as toxic; one without any word never does."""
    return F.coalesce(text, F.lit("")).rlike(r"\S") & (p_toxic >= REJECT)
