import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hopweave.llm import langid

TRAIN = [("the cat and the hat", "en"), ("that is the one", "en"), ("der hund und die katze", "de"), ("das ist gut so", "de"), (None, "en"), ("no label", None), ("123 !!", "de")]


def brute(texts):
    """Scalar naive Bayes over the same buckets."""
    grams = lambda t: [b for o in langid.ORDERS for b in langid.ngram_buckets(np.array([ord(c) for c in f" {t.lower()} "], np.uint64), o).tolist()]
    counts, docs = defaultdict(Counter), Counter()
    for t, g in TRAIN:
        if t and g and any(c.isalpha() for c in t):
            counts[g].update(grams(t))
            docs[g] += 1
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append("und")
            continue
        score = {}
        for g in sorted(counts):
            total = sum(counts[g].values()) + 0.5 * langid.BUCKETS
            score[g] = math.log(docs[g] / sum(docs.values())) + sum(math.log((counts[g][b] + 0.5) / total) for b in grams(t))
        out.append(max(score, key=lambda g: score[g]))
    return out


def test_predictions_equal_scalar_bayes(spark):
    model = langid.fit(spark.createDataFrame([(t, g, 1) for t, g in TRAIN], "text string, lang string, n int"))
    assert model.langs == ["de", "en"]
    texts = ["the hund", "katze und hat", "THE ONE", "", None, "42 ...", "a", "ß", "und " * 5000, "the that " * 300_000]
    assert [g for g, _ in model.predict(texts)] == brute(texts)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "i int, text string, lang_pred string")
    got = langid.predict(df, model).sort("i").collect()
    assert [r.lang_pred for r in got] == brute(texts)
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert model.predict(["text", None]) == [("und", 0.0), ("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() > 150 and share > 0.97
