import hashlib
from collections import Counter

import pytest

from hopweave.llm import sharding


def brute(n, m):
    """Turn by turn over whole preference lists."""
    h = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    lists = [[(h(f"offset-{s}") % m + j * (h(f"skip-{s}") % (m - 1) + 1)) % m for j in range(m)] for s in range(n)]
    assert all(len(set(x)) == m for x in lists)
    owner = {}
    while len(owner) < m:
        for s in range(n):
            if len(owner) < m:
                owner[next(x for x in lists[s] if x not in owner)] = s
    return [owner[i] for i in range(m)]


def test_fill_equals_turns():
    assert sharding.fill(7, 211) == brute(7, 211)
    assert sharding.fill(1, 2) == [0, 0]
    n = Counter(sharding.fill(16, 1609)).values()
    assert max(n) - min(n) <= 1
    for bad in ((3, 10), (0, 7), (9, 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_few_slots_move():
    a, b = sharding.fill(16, 1609), sharding.fill(17, 1609)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 1609 / 4


def test_place(spark):
    rows = [(i, "x", -1) for i in [*range(50), 7, 7]] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, note string, shard int")
    out = sharding.place(df, "doc_id", 5, 101)
    assert out.columns == ["doc_id", "note", "slot", "shard"]
    table = brute(5, 101)
    for r in out.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    assert out.count() == 53 and sharding.place(df.limit(0), "doc_id").count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
    assert sharding.place(df, "shard", 5, 101).columns[-2:] == ["slot", "shard"]


def test_clashing_names_and_letter_case(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, Slot string, SHARD string")
    assert sorted(r.slot for r in sharding.place(df, "doc_id", 5, 101).collect()) == sorted(r.slot for r in sharding.place(df.select("doc_id"), "doc_id", 5, 101).collect())
    out = sharding.place(df, "Slot", 5, 101)
    assert out.columns == ["doc_id", "Slot_key", "slot", "shard"] and sorted(r.Slot_key for r in out.collect()) == ["x", "y"]
