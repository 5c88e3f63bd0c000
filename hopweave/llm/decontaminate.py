"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to k = floor(RATE * n) edits. Cut
into k + 1 pieces, at least one piece is then untouched, so an exact search for
all pieces (one Aho-Corasick automaton) finds every occurrence; a hit fixes the
window in which the item must lie, and Myers' bit-parallel distance decides.

Texts and items are compared in lower case with white space collapsed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import forget, union_all, written

#: Share of an item's characters that may be edited.
RATE = 0.05
#: Characters of items that one automaton, and so one broadcast, holds, about; a larger benchmark is taken in
#: blocks of that size, one after the other.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, int]]:
    """k + 1 spans of nearly equal length that cover the item."""
    cut = [len(item) * j // (k + 1) for j in range(k + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << j
    return out


def myers(where: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the window, first end of one)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window):
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        ph, mh = down | (~(x | up) & full), up & x
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere
        up, down = (mh | (~((eq | down) | ph) & full)), ph & (eq | down)
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t, budget(t, rate), masks(t)) for i, t in items if t]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for j, (_, t, k, _) in enumerate(self.items):
            for a, b in pieces(t, k):
                by_piece.setdefault(t[a:b], []).append((j, a))
        self.automaton = ahocorasick.Automaton()
        for p, at in by_piece.items():
            self.automaton.add_word(p, (len(p), at))
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, end) of the best occurrence of every item within its budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (size, at) in self.automaton.iter(text):
            for j, a in at:
                _, t, k, _ = self.items[j]
                start = last - size + 1 - a
                lo, hi = max(0, start - k), min(len(text), start + len(t) + k)
                have = spans.setdefault(j, [])
                if have and lo <= have[-1][1]:  # hits of an item come with rising places but not with rising starts
                    have[-1] = [min(lo, have[-1][0]), max(hi, have[-1][1])]
                else:
                    have.append([lo, hi])
        out = []
        for j, windows in spans.items():
            _, t, k, where = self.items[j]
            got = min((d, lo + e) for (lo, hi) in windows for d, e in [myers(where, len(t), text[lo:hi])])
            if got[0] <= k:
                out.append((j, *got))
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, normalised and without blank ones, in blocks of about BLOCK_CHARS characters, fetched
    one at a time. Sizes are measured in Spark first; items are dealt by a hash."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.trim("text") != "")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i) if n > 1 else rows
        block = [(r[0], normal(r[1])) for r in part.collect()]
        if block:
            yield block


#: The automaton of a worker, by the name of the block it was made from.
_MATCHER: dict[str, Matcher] = {}


def _matcher(name: str, shared: Broadcast, rate: float) -> Matcher:
    if name not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[name] = Matcher(shared.value, rate)
    return _MATCHER[name]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, end): each document row's best occurrence of each
    item within the budget; ``end`` is its first end in the normalised text.

    Items that are null or blank match nothing; null and empty texts have no
    match; repeated rows match each for itself; other columns are ignored.
    """
    spark, many = docs.sparkSession, []
    schema = "doc_id long, item_id long, edits int, end long"
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def found(shared: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, shared, rate)
            for batch in batches:
                rows = [(d, m.items[j][0], e, end) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for j, e, end in m.match(normal(t.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "item_id", "edits", "end"])

        return rows.mapInArrow(run, schema)

    shared = None
    for block in blocks(items):
        if shared is not None:  # the block before is not the last: its matches are written, and it goes
            many.append(written(found(shared), "matches"))
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
    last = spark.createDataFrame([], schema) if shared is None else found(shared)
    return union_all([*many, last])


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows in which an item occurs; columns and all other rows stay."""
    spark, at, columns = docs.sparkSession, docs.columns.index("text"), docs.schema

    def kept(docs: DataFrame, shared: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not m.match(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(run, columns)

    shared, old = None, None
    for block in blocks(items):
        if shared is not None:
            docs = written(kept(docs, shared), "clean")
            shared.destroy()
            if old is not None:
                forget(old)
            old = docs
        shared = spark.sparkContext.broadcast(block)
    return docs if shared is None else kept(docs, shared)
