import random

from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import decontaminate as d


def distance(item, text):
    """Least edit distance to a substring, and its first end, by the full table."""
    col = list(range(len(item) + 1))
    best = (col[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(col[i - 1] + (x != c), col[i] + 1, new[i - 1] + 1))
        col = new
        best = min(best, (col[-1], j))
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abcd", max_size=90))
def test_myers_equals_table(item, text):
    assert d.myers(d.masks(item), len(item), text) == distance(item, text)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    items = [(i, text(rng.randint(8, 30))) for i in range(12)] + [(90, None), (91, "  "), (92, "Short")]
    docs = ["", None, "short", "x" * 30000]
    for _ in range(60):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 12)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["z"], [t[i], "q"]])
        docs.append(text(rng.randint(0, 30)) + " " + "".join(t).upper().replace(" ", "\n  ") + " " + text(rng.randint(0, 30)))
    return docs, items


def test_matches_equal_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = []
    for i, t in enumerate(docs):
        for j, x in items:
            x, n = d.normal(x), d.normal(t)
            if x and n:
                e, end = distance(x, n)
                if e <= d.budget(x):
                    want.append((i, j, e, end))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.matches(df, frame).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and len(got) > 10
    dirty = {w[0] for w in want}
    assert sorted(r.doc_id for r in d.clean(df, frame).collect()) == [i for i in range(len(docs)) if i not in dirty]
    # a benchmark beyond one block gives the same
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, d.matches(df, frame).collect())) == got
    assert d.matches(df, frame.limit(0)).count() == 0 == d.matches(df.limit(0), frame).count()
    assert d.clean(df, frame.limit(0)).count() == len(docs)
