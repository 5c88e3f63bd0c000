import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hopweave.llm import suffix


def brute(texts):
    """(bytes kept, removed, spans) of each text."""
    L = suffix.LENGTH
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + L] for r in raw for i in range(len(r) - L + 1))
    out = []
    for r in raw:
        dead = np.zeros(len(r), bool)
        for i in range(len(r) - L + 1):
            if n[r[i : i + L]] > 1:
                dead[i : i + L] = True
        spans = int((np.diff(dead.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(dead.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~dead].tobytes()).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(30, 90)) for _ in range(4)]
    out = [None, "", "short", "a" * 1500, "ab" * 400, "x" * 199, "y" * 200]
    for _ in range(n):
        parts = [text(rng.randint(1, 60))]
        if rng.random() < 0.7:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : a + rng.randint(180, 420)], text(rng.randint(1, 40))]
        out.append("".join(parts))
    near = text(150)
    for _ in range(8):
        i = rng.randrange(len(near))
        out.append(near[:i] + "#" + near[i + 1 :])
    return out + [out[-1], out[8]]


@pytest.mark.parametrize(("seed", "tasks"), [(1, None), (2, 7), (6, 60)])
def test_report_equals_brute_force(spark, monkeypatch, seed, tasks):
    if tasks:  # so many that groups are cut between tasks in both orders
        monkeypatch.setattr(suffix, "tasks_for", lambda *_: tasks)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, uid int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(df).collect()}
    want = dict(enumerate(brute(texts)))
    assert [i for i in want if got[i] != want[i]] == []
    assert sum(w[1] for w in want.values()) > 0


def test_windows_of_cut_groups(spark, monkeypatch):
    """One string before which and behind which few different bytes stand, in all combinations,
    over more tasks than each side has kinds: most windows are left to the count."""
    monkeypatch.setattr(suffix, "tasks_for", lambda *_: 50)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklm", k=n))
    middle, before, behind = word(60), [word(150) for _ in range(6)], [word(150) for _ in range(6)]
    texts = [before[i] + middle + behind[j] + f"{i} {j}" for i in range(6) for j in range(6) if (i + j) % 5]
    texts += [word(150) + middle + b[:120] + "!" for b in behind]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_equals_pairs():
    rng = np.random.default_rng(4)
    n, L, left_n = 80, suffix.LENGTH, suffix.LEFT
    left, right = (np.repeat(rng.integers(97, 100, (6, k)), 14, 0)[:n].astype(np.uint8) for k in (left_n, L))
    for m in (left, right):
        m[:] = m[rng.permutation(n)]
        m[np.arange(n), rng.integers(0, m.shape[1], n)] = 35
    right[:, : suffix.GRAM] = 65
    group = np.sort(rng.integers(0, 3, n))
    first, last = rng.integers(0, 40, n), rng.integers(90, left_n + 1, n)
    got = suffix.repeated(group, left, right, first, last)[0]
    for i in range(n):
        for o in range(left_n + 1):
            same = [j for j in range(n) if j != i and group[j] == group[i] and first[j] <= o <= last[j] and (left[j, :o] == left[i, :o]).all() and (right[j, : L - o] == right[i, : L - o]).all()]
            assert got[i, o] == (first[i] <= o <= last[i] and bool(same))


def test_clashing_names_and_letter_case(spark):
    t = "once more " * 60
    for names in ("_key string, _text string", "key string, new string", "KEY string, New string"):
        df = spark.createDataFrame([(1, t, "x", "r"), (2, t + "tail", "y", "s"), (3, "alone", "z", "t")], f"doc_id long, text string, {names}")
        out = suffix.deduplicate(df)
        assert out.columns == df.columns
        assert sorted((r[0], r[2], r[3]) for r in out.collect()) == [(1, "x", "r"), (2, "y", "s"), (3, "z", "t")]


def test_deep_shallow_sorts(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(97, 99, (5, 200)).astype(np.uint8)
    rows = base[rng.integers(0, 5, 300)].copy()
    rows[np.arange(300), rng.integers(0, 200, 300)] = 120
    group = rng.integers(0, 4, 300)
    order = suffix.deep_shallow(group, rows)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_texts_keep_columns(spark):
    t = "once more " * 60
    df = spark.createDataFrame([(1, t, "x"), (2, t + "tail", "y"), (None, None, None), (3, "alone", "z")], "doc_id long, text string, _other string")
    got = {r.doc_id: r for r in suffix.deduplicate(df).collect()}
    assert df.columns == suffix.deduplicate(df).columns and len(got) == 4
    assert got[None].text is None and got[3].text == "alone" and len(got[1].text) < 200
    assert suffix.report(df.limit(0)).count() == 0


def test_anchors_of_long_texts_are_unique(monkeypatch):
    texts = [(t or "").encode() for t in corpus(3)] + [" ".join(t or "" for t in corpus(4)).encode()]
    places = lambda: [tuple(int(x) for x in p) for rows in suffix.anchors(texts) for p in zip(*rows, strict=True)]
    whole = places()
    monkeypatch.setattr(suffix, "PASS", 500)
    assert len(texts[-1]) > 10_000 and sorted(places()) == sorted(whole)


def test_nothing_is_cut_at_the_border_of_a_pass(spark):
    # workers read PASS from the module, so the text is as long as it takes for two borders
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=2 * suffix.PASS + 1000))
    texts = [long, "x" * 30 + long[2 * suffix.PASS - 150 : 2 * suffix.PASS + 150]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(df).collect()}
    assert got == dict(enumerate(brute(texts)))
