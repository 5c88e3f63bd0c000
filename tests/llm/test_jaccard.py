import random
import re

import numpy as np
import pytest

from hopweave.llm import jaccard


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(ids, texts, width, percent):
    s = sets_of(texts, width)
    up = list(range(len(s)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
                up[top(i)] = top(j)
    low = {}
    for i, d in enumerate(ids):
        low[top(i)] = min(low.get(top(i), d), d)
    return [(d, len(s[i]), low[top(i)]) for i, d in enumerate(ids)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    line = text(12)
    out = [None, "", " \t\n", "One two", "one  TWO", "one two three", "é É", "É É", "x " * 3000]
    for _ in range(6):
        base = text(rng.randint(20, 120))
        for _ in range(rng.randint(1, 14)):
            t = base[:]
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t + (line if rng.random() < 0.3 else [])))
    return out + [out[-1], out[10], ""]


@pytest.mark.parametrize(("seed", "block", "width", "percent"), [(1, 512, 4, 85), (2, 3, 5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block, width, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # 3: groups are met in pairs of blocks
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, 1, b"k") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, uid int, key binary")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, width, percent).collect())
    assert got == sorted(brute(ids, texts, width, percent))
    kept = sorted(r.doc_id for r in jaccard.keep_one(df, width, percent).collect())
    blank = {i for i, t in zip(ids, texts, strict=True) if not (t or "").split()}
    assert kept == sorted({c for d, _, c in got if d not in blank} | blank)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (None, "other words here", "y"), (2, " ", "z"), (2, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _class string")
    got = jaccard.join(df)
    assert sorted((r.doc_id is None, r.component_id or 0) for r in got.collect()) == [(False, 1), (False, 1), (False, 2), (False, 2), (True, 0), (True, 1)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "other words here"), (1, "a b c d e f"), (2, " "), (2, " ")]
    assert jaccard.join(df.limit(0)).count() == jaccard.keep_one(df.limit(0)).count() == 0


def test_prefix_choice_is_complete():
    # any two sets that are similar share min(l, l') shingles of their prefixes
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(4, 60))
        a = set(range(n))
        b = {x if rng.random() > 0.08 else 1000 + x for x in a}
        freq = {x: int(rng.integers(2, 9)) for x in a | b}
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        pre = []
        for s in (a, b):
            order = sorted(s, key=lambda x: (freq[x], x))
            l, p = jaccard.choose(np.array([freq[x] for x in order], np.uint32), n, 80)
            pre.append((l, set(order[:p])))
        assert len(pre[0][1] & pre[1][1]) >= min(pre[0][0], pre[1][0])


@pytest.mark.parametrize("part_bytes", [64, 1])
def test_parts_of_several_levels(spark, monkeypatch, part_bytes):
    """More parts than one level deals by: the same frequencies, no part over its share."""
    monkeypatch.setattr(jaccard, "LEVEL_BITS", 8)
    monkeypatch.setattr(jaccard, "PART_BYTES", part_bytes)
    texts = corpus(5)
    assert jaccard.bits_for(sum(len(t or "") for t in texts)) > 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 4, 85).collect())
    assert got == sorted(brute(range(len(texts)), texts, 4, 85))


def test_packets_are_exact():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    whole = jaccard.Packet(np.array([7 << 33]), np.array([500]), np.sort(rng.integers(0, 90, 500)), tokens)
    again = []
    for part, packet in whole.dealt(9):
        back = jaccard.Packet.joined([packet.packed(), packet.packed()], part >> 1)
        assert (back.token >> np.uint64(55) == part).all() and back.count.tolist() == [len(packet.token)] * 2
        again += [(int(t), int(w)) for t, w in zip(packet.token, packet.who, strict=True)]
    assert sorted(again) == sorted(zip(tokens.tolist(), whole.who.tolist(), strict=True))


def test_bits_follow_the_size():
    assert jaccard.bits_for(0) == 8 and jaccard.bits_for(1 << 40) == 17


def test_clashing_names_and_letter_case(spark):
    rows = [(1, "a b c d e f", "x", "r"), (2, "a b c d e f", "y", "s"), (3, "g", "z", "t")]
    for names in ("_key string, _row string", "key string, row string", "KEY string, Row string", "class string, times string"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
