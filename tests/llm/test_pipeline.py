import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from hopweave.llm import decontaminate, jaccard, pieces, suffix, toxicity
from hopweave.llm.common import table, written
from tests.llm.test_decontaminate import distance
from tests.llm.test_jaccard import brute as classes_of
from tests.llm.test_suffix import brute as cut_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SMALL, "documents")]
    for name, stage in p.STAGES:
        docs.append(written(stage(spark, docs[-1], SMALL), "t"))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1]) and len(steps) == 6


def test_toxicity(spark, steps):
    model = toxicity.chain_of(steps[0], table(spark, SMALL, "labels"))
    ids = [r.doc_id for r in toxicity.score(steps[0], model).where(F.col("p_toxic") < toxicity.REJECT).collect()]
    assert sorted(texts(steps[1])) == sorted(ids)


def test_one_of_each_class(steps):
    before = texts(steps[1])
    ids = sorted(before)
    keep = {c for _, _, c in classes_of(ids, [before[i] for i in ids], p.WIDTH, p.PERCENT)}
    assert set(texts(steps[2])) == keep


def test_repeats_are_cut(steps):
    before, after = texts(steps[2]), texts(steps[3])
    ids = sorted(before)
    for i, (n, gone, _, _) in zip(ids, cut_of([before[i] for i in ids]), strict=True):
        assert abs(len((after[i] or "").encode()) - (n - gone)) <= 6 if gone else after[i] == before[i]
    assert {r.doc_id: r.n_chars for r in steps[3].collect()} == {i: len(t) for i, t in after.items()}


def test_benchmark_goes(spark, steps):
    items = [decontaminate.normal(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    before, after = texts(steps[3]), texts(steps[4])
    dirty = {i for i, t in before.items() if any(x in decontaminate.normal(t) for x in items)}
    assert dirty <= set(before) - set(after)
    for i in set(before) - set(after) - dirty:
        t = decontaminate.normal(before[i])
        assert any(distance(x, t)[0] <= decontaminate.budget(x) for x in items)


def test_pieces_decode(steps):
    v = pieces.solver(p.PIECES).v
    after = texts(steps[4])
    got = {r.doc_id: r.ids for r in steps[5].collect()}
    assert set(got) == set(after)
    import numpy as np

    assert all(pieces.decode(v, np.array(got[i])) == (after[i] or "") for i in got)


def test_run(spark, steps):
    assert p.run(spark, SMALL).count() == steps[5].count()


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g", None, "s", 13), (2, "a b c d e f g", None, "s", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (df, df.limit(0)):
        for _, stage in p.STAGES[:-1]:
            frame = stage(spark, frame, SMALL)
            assert frame.columns == df.columns
        assert p.STAGES[-1][1](spark, frame, SMALL).count() in (0, 4)
    assert jaccard and suffix
