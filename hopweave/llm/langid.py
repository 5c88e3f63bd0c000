"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every training text (no sample): each task adds up
its own counts, so only one row per language, bucket and task is shuffled.  The
log-probability matrix (languages x buckets, float32) has a size that does not
grow with the corpus and is broadcast; scoring is a vectorised gather and sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.common import chunks, mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Code points per pass of the numpy kernel; bounds its memory.
PASS = 1 << 20
UND = "und"


def _letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def ngram_buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = h * np.uint64(0x100000001B3) + codes[k : n + k]
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a whole text, a bounded piece at a time."""
    for lo in range(0, len(codes), PASS):
        for order in ORDERS:
            yield ngram_buckets(codes[lo : lo + PASS + order - 1], order)


class Model:
    """``langs`` in ascending order; ``table`` is (buckets, langs) of log probabilities."""

    def __init__(self, langs: list[str], priors: np.ndarray, counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.table = np.ascontiguousarray(np.log((counts + alpha) / (total + alpha * counts.shape[1])).T.astype(np.float32))
        self.prior = np.log(priors / priors.sum()) if len(langs) else np.zeros(0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Ties go to the language that sorts first. The score is the posterior
        of the mean log likelihood a 3-gram start, so that it does not saturate."""
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        if not self.langs:
            return out
        live = [i for i, t in enumerate(texts) if _letter(t)]
        for lo, hi in chunks([len(texts[i]) for i in live], PASS):
            part = [_codes(texts[i]) for i in live[lo:hi]]
            sums = np.zeros((len(part), len(self.langs)))
            if len(part) == 1:
                for b in _windows(part[0]):
                    sums[0] += np.bincount(b, minlength=BUCKETS) @ self.table.astype(np.float64)
            else:
                codes, lens = np.concatenate(part), np.array([len(p) for p in part])
                start = np.concatenate(([0], np.cumsum(lens)[:-1]))
                for order in ORDERS:
                    b = np.append(ngram_buckets(codes, order), np.zeros(order - 1, np.int64))
                    scores = self.table[b]
                    for k in range(1, order):  # n-grams that would reach into the next text
                        scores[np.maximum(start + lens - k, start)] = 0
                    sums += np.add.reduceat(scores, start, axis=0, dtype=np.float64)
            n = np.array([len(p) for p in part], float)[:, None]
            full = sums + self.prior
            best = full.argmax(1)
            soft = np.exp((sums - sums.max(1, keepdims=True)) / n * 16)
            soft /= soft.sum(1, keepdims=True)
            for j, i in enumerate(live[lo:hi]):
                out[i] = (self.langs[best[j]], float(soft[j, best[j]]))
        return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all rows with a text that has a letter and a non-null language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not _letter(t):
                    continue
                docs[g] = docs.get(g, 0) + 1
                if g not in sums:
                    sums[g] = np.zeros(BUCKETS, np.int64)
                for b in _windows(_codes(t)):
                    if len(b) > BUCKETS // 8:
                        sums[g] += np.bincount(b, minlength=BUCKETS)
                    else:
                        np.add.at(sums[g], b, 1)
        for g, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], docs[g]))], ["lang", "bucket", "n"])

    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = (got.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    langs = sorted(set(names))
    counts, priors = np.zeros((len(langs), BUCKETS)), np.ones(len(langs))
    at = np.array([langs.index(x) for x in names], int) if len(names) else np.zeros(0, int)
    prior = bucket == -1
    priors[at[prior]] = n[prior]
    counts[at[~prior], bucket[~prior].astype(int)] = n[~prior]
    return Model(langs, priors, counts)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` string and ``score`` double (0 to 1).

    The prediction is the language of the largest posterior. The score is no posterior:
    it is the predicted language's share by the mean likelihood of an n-gram, without
    the prior, so that long texts do not all get 1; on very short texts another
    language's share may be larger.

    A null, empty or letterless text gives ``und`` with score 0, as every text
    does when nothing was learned. Whole texts are read, of any length.
    Existing columns of these two names are replaced; all rows stay.
    """
    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    # lang and source never reach the prediction
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
