import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import toxicity as x


def test_features_find_words_and_beginnings():
    got = {}
    for row, h in x.features(["Bad, words", None, "badly", "ß" * 9, "word " * 300_000]):
        for r, f in zip(row.tolist(), h.tolist(), strict=True):
            got.setdefault(r, set()).add(f)
    assert 1 not in got and len(got) == 4
    assert got[0] & got[4]  # "word" of "words"
    assert not got[0] & got[2]  # beginnings have four bytes at least


def scalar_chain(texts, y):
    """The whole training, a row and a feature at a time: (features, weights, chained, bias) of each link."""
    have = []
    for t in texts:
        have.append({f for _, h in x.features([t]) for f in h.tolist()})
    packed = [np.array(sorted(f), "<u8").tobytes() for f in have]

    def chosen(rows, c):
        n, p = len(rows), sum(y[r][c] for r in rows)
        n1, n0 = float(max(1, p)), float(max(1, n - p))
        count, pos = {}, {}
        for r in rows:
            for f in have[r]:
                count[f] = count.get(f, 0) + 1
                pos[f] = pos.get(f, 0) + y[r][c]
        rated = []
        for f, k in count.items():
            share = k / (n1 + n0)
            z = abs(pos[f] / n1 - (k - pos[f]) / n0) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
            if k >= x.LEAST_DOCS and z >= x.LEAST_Z:
                rated.append((-z, f - (1 << 64) * (f >> 63), f))
        return sorted(f for _, _, f in sorted(rated)[: x.FEATURES])

    def fitted(rows, c, before):
        names = chosen(rows, c)
        m = [[float(f in have[r]) for f in names] + before[r] + [1.0] for r in rows]
        w, k = [0.0] * (len(names) + c + 1), len(names) + c + 1
        for _ in range(12):
            grad = [-(1.0 if j < k - 1 else 1e-3) * w[j] for j in range(k)]
            hess = [[(1.0 if i < k - 1 else 1e-3) * (i == j) for j in range(k)] for i in range(k)]
            for v, r in zip(m, rows, strict=True):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(v, w, strict=True))))))
                for i in range(k):
                    if v[i]:
                        grad[i] += v[i] * (y[r][c] - p)
                        for j in range(k):
                            hess[i][j] += v[i] * v[j] * (p * (1 - p) + 1e-9)
            step = np.linalg.solve(hess, grad)
            w = [a + b for a, b in zip(w, step, strict=True)]
            if max(map(abs, step)) < 1e-6:
                break
        return names, w[: len(names)], w[len(names) : -1], w[-1]

    def score(link, r, before):
        names, w, chained, bias = link
        return 1 / (1 + math.exp(-(bias + sum(a for f, a in zip(names, w, strict=True) if f in have[r]) + sum(a * b for a, b in zip(chained, before, strict=True)))))

    return have, packed, fitted, score


def test_whole_training_equals_a_scalar_one(spark):
    assert x.TRAIN_ROWS == 8000
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(60)])
    texts = [" ".join(rng.choice(words, 8)) + (" vile scum" if i % 3 == 0 else "") + (" spam" if i % 4 == 0 and i % 5 else "") for i in range(240)]
    texts += texts[:30]  # copies share a fold
    y = [(int(i % 240 % 4 == 0), int(i % 240 % 3 == 0)) for i in range(270)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, y0 int, _label_id string")
    labels = spark.createDataFrame([(i, 1 - a, b) for i, (a, b) in enumerate(y)], "doc_id long, quality int, toxic int")
    got = x.chain_of(df, labels)
    have, packed, fitted, score = scalar_chain(texts, y)
    frame = spark.createDataFrame([(p,) for p in packed], "f binary")
    fold = [r[0] for r in frame.select(F.pmod(F.xxhash64("f"), F.lit(x.FOLDS))).collect()]
    assert fold[:30] == fold[240:] and len(set(fold)) > 1
    rows, links, before = range(270), [], [[] for _ in range(270)]
    for c in range(2):
        links.append(fitted(rows, c, before))
        if not c:
            out = {f: fitted([r for r in rows if fold[r] != f], c, before) for f in set(fold)}
            before = [[score(out[fold[r]], r, [])] for r in rows]
    for link, (names, w, chained, bias) in zip(got.links, links, strict=True):
        assert got.known[link.at].tolist() == names and names
        assert np.allclose(link.weight, w, atol=1e-6) and np.allclose(link.chained, chained, atol=1e-6) and np.isclose(link.bias, bias, atol=1e-6)


def test_random_labels_leave_nothing_out_of_fold(spark):
    rng = np.random.default_rng(7)
    words = np.array([f"word{i}" for i in range(15000)])
    texts = [" ".join(rng.choice(words, 40)) for _ in range(3000)]
    y = rng.random(3000) < 0.04
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(y.tolist())], "doc_id long, quality int, toxic int")
    model = x.chain_of(df, labels)
    p, y = model.out_of_fold[:, 0], model.labels[:, 0] > 0
    assert len(model.links[0].at) > 20  # in-sample, noise looks like signal
    above = (p[y][:, None] > p[~y][None, :]).mean() + (p[y][:, None] == p[~y][None, :]).mean() / 2
    assert 0.4 < above < 0.6


def test_clashing_names_and_letter_case(spark):
    rows = [(i, f"some filler text {'vile scum' if i % 3 == 0 else 'nice words'}", 1, 2, "x", 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y0 int, Y1 int, _label_id string, P_Toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "z") for i in range(60)], "doc_id long, quality int, toxic int, text string")
    out = x.score(df, x.chain_of(df, labels))
    assert out.columns == ["doc_id", "text", "y0", "Y1", "_label_id", "p_low_quality", "p_toxic"]
    assert all((r.p_toxic >= x.REJECT) == (r.doc_id % 3 == 0) for r in out.collect())


def test_score_is_the_plain_formula(spark):
    docs = [(i, f"some filler text {'vile scum' if i % 3 == 0 else 'nice words'} number{i % 7}", i) for i in range(300)] + [(900, None, 0), (901, "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(250)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = x.chain_of(df, labels)
    got = {r.doc_id: r for r in x.score(df, model).collect()}
    assert len(got) == len(docs)
    assert all((got[i].p_toxic >= x.REJECT) == (i % 3 == 0) for i in range(300))
    assert got[900].p_toxic == got[901].p_toxic
    for i in (0, 1, 299):
        have = {f for _, h in x.features([docs[i][1]]) for f in h.tolist()}
        before = []
        for link in model.links:
            z = link.bias + sum(w for k, w in zip(link.at, link.weight, strict=True) if model.known[k] in have) + sum(c * p for c, p in zip(link.chained, before, strict=True))
            before.append(1 / (1 + np.exp(-z)))
        assert got[i].p_low_quality == pytest.approx(before[0]) and got[i].p_toxic == pytest.approx(before[1])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "documents"))
    model = x.chain_of(docs, labels.where("doc_id % 4 <> 1"))
    got = x.score(docs, model).join(labels.where("doc_id % 4 = 1").dropna(), "doc_id").where("text is not null")
    n = {(r.toxic, r.hit): r["count"] for r in got.groupBy("toxic", (F.col("p_toxic") >= x.REJECT).alias("hit")).count().collect()}
    caught, spared = n[1, True] / (n[1, True] + n.get((1, False), 0)), n[0, False] / (n[0, False] + n.get((0, True), 0))
    assert caught > 0.95 and spared > 0.99, n


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    model = x.chain_of(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert x.score(df, model).first().p_toxic < 0.5000001
    assert x.score(df.limit(0), model).count() == 0
