"""Suffix-array dedup: removes every byte that a repeated window covers.

A window is any ``LENGTH`` bytes of one text; it is repeated if the same bytes
also start anywhere else. The suffixes to sort are sampled so that equal windows
agree on them: among the ``GRAM``-byte strings of a window the one of least hash
is its anchor, and equal windows have it at the same place. Suffixes from
anchors whose string occurs once need no sorting. The others are brought together
by that string, reduced to distinct surroundings (``LEFT`` bytes before, LENGTH
behind), and deep-shallow sorted: multikey quicksort, eight bytes a key, to a
shallow depth, then a blind trie for each group that is still equal. The strings before
the anchors, read backwards, are sorted in the same way. A window that starts o bytes
before its anchor is repeated if another surrounding is in the same run of common
prefixes of LENGTH - o bytes in the one order and of o bytes in the other.

Surroundings that are equal as a whole are one row with a count before they are sorted.
The rows are dealt to tasks by ranges of (string, bytes behind the anchor), so a string
on any number of rows is sorted in as many tasks as it takes. What such a cut could hide
are windows whose run reaches the border of a task. They are sorted again, dealt by the
bytes before the anchor, and only windows whose runs reach a border in both orders
are left to be counted by their bytes, each distinct one once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import distinct_texts, forget, free_name, prefix_hash, span_hash, tasks_for, text_key, union_all, written

LENGTH, GRAM = 200, 50
LEFT = LENGTH - GRAM
#: Rows that are sorted at a time, whole groups.
ROWS = 8192
#: Bytes a kernel pass takes.
PASS = 1 << 17
#: Depth of the quicksort in bytes; the anchor's own GRAM bytes are equal anyway.
SHALLOW = 112


# ------------------------------------------------------------------- anchors


def units(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Bounded batches of (text, lo, hi, first, last): bytes lo:hi of a text hold the
    windows that start at first:last with the surroundings of their anchors."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for first in range(0, len(t) - LENGTH + 1, PASS):
            last = min(first + PASS, len(t) - LENGTH + 1)
            u = (i, max(0, first - LEFT), min(len(t), last + LEFT + LENGTH), first, last)
            if batch and size + u[2] - u[1] > PASS:
                yield batch
                batch, size = [], 0
            batch.append(u)
            size += u[2] - u[1]
    if batch:
        yield batch


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for every i, padded with the largest value."""
    n = len(keys)
    top = np.iinfo(np.uint64).max
    rows = -(-n // width) + 1
    padded = np.full(rows * width, top, np.uint64)
    padded[:n] = keys
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, h, ck1, ck2): each anchor once, the hash of its string and of its surroundings."""
    last_of = (-1, -1)  # text and place of the last anchor: the next unit of the text may start with it
    for batch in units(texts):
        data = np.frombuffer(b"".join([texts[i][lo:hi] for i, lo, hi, _, _ in batch]), np.uint8)
        base = np.concatenate(([0], np.cumsum([hi - lo for _, lo, hi, _, _ in batch])))
        p1, p2 = prefix_hash(data), prefix_hash(data, 7)
        at = np.arange(len(data) - GRAM + 1)
        h = span_hash(p1, at, at + GRAM)
        # leftmost of the least by 40 bits of hash: told by the window's bytes alone
        low = window_minima(h >> np.uint64(24) << np.uint64(24) | at.astype(np.uint64), LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)
        for (i, lo, hi, first, last), b in zip(batch, base[:-1].tolist(), strict=True):
            found = low[b + first - lo : b + last - lo]
            a = np.unique(found[np.concatenate(([True], found[1:] != found[:-1]))]).astype(np.int64)
            # places never fall from one window to the next, so only the first can be known
            a = a[int((i, a[0] - b + lo) == last_of) :]
            if not len(a):
                continue
            last_of = (i, a[-1] - b + lo)
            left, right = np.maximum(a - LEFT, b), np.minimum(a + LENGTH, b + hi - lo)
            shape = ((a - left) * 1000 + right - a).astype(np.uint64)
            yield np.full(len(a), i), a - b + lo, h[a], span_hash(p1, left, right) ^ shape, span_hash(p2, left, right)


# ------------------------------------------------------------ deep-shallow sort


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of equally long strings, by a trie that keeps only branching bytes.

    A node is [depth, {byte: child}], a leaf the list of the strings equal to it. A string
    goes down blindly, is compared once with a leaf it meets, and is put where
    they part."""
    root: list = [strings[0], [0]]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node[0], int):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        d = common(s, node[0])
        if d == len(s):
            node[1].append(i)
            continue
        above, key, node = None, 0, root
        while isinstance(node[0], int) and node[0] < d:
            above, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node[0], int) and node[0] == d:
            node[1][s[d]] = [s, [i]]
            continue
        other = node
        while isinstance(other[0], int):
            other = next(iter(other[1].values()))
        fork = [d, {other[0][d]: node, s[d]: [s, [i]]}]
        if above is None:
            root = fork
        else:
            above[1][key] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[0], int):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node[1]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix by (group, bytes)."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    run = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    for w in range(min(SHALLOW, width) // 8):
        # only groups that are still equal are sorted by their next key
        ids = np.cumsum(run) - 1
        open_ = np.bincount(ids)[ids] > 1
        if not open_.any():
            return order
        part = order[open_]
        order[open_] = part[np.lexsort((words[part, w], ids[open_]))]
        key = words[order, w]
        run[1:] |= open_[1:] & (key[1:] != key[:-1])
    ends = np.append(np.flatnonzero(run), n)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            part = order[a:b]
            order[a:b] = part[blind_trie([rows[i].tobytes() for i in part])]
    return order


def common_prefixes(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in ``order``; 0 at a group's first."""
    out = np.zeros(len(order), np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    out[1:][group[order[1:]] != group[order[:-1]]] = 0
    return out


def repeated(group: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which windows are repeated within their group: a row of flags for each surrounding, by
    how many bytes before the anchor a window starts; and both orders with their common prefixes.

    ``left`` holds the bytes before an anchor, nearest first, ``right`` those from
    it on, padded; windows from ``first`` to ``last`` have no padding."""
    n = len(group)
    by_right, by_left = deep_shallow(group, right), deep_shallow(group, left)
    r, l = common_prefixes(group, right, by_right), common_prefixes(group, left, by_left)  # noqa: E741
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    at_right[by_right], at_left[by_left] = np.arange(n), np.arange(n)
    most_right, most_left = np.maximum(r, np.append(r[1:], 0))[at_right], np.maximum(l, np.append(l[1:], 0))[at_left]
    lo, hi = np.maximum(first, LENGTH - most_right), np.minimum(last, most_left)
    out = np.zeros((n, LEFT + 1), bool)
    live = np.flatnonzero(lo <= hi)
    if len(live):
        lo, hi, at_right, at_left = lo[live], hi[live], at_right[live], at_left[live]
        for o in range(int(lo.min()), int(hi.max()) + 1):
            here = np.flatnonzero((lo <= o) & (o <= hi))
            if len(here) > 1:
                # windows are equal where both runs are
                key = np.cumsum(r < LENGTH - o)[at_right[here]] * (n + 1) + np.cumsum(l < o)[at_left[here]]
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                hit = np.zeros(len(here), bool)
                hit[1:] |= same
                hit[:-1] |= same
                out[live[here[order[hit]]], o] = True
    return out, (by_right, r), (by_left, l)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of True in each row."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1]


# --------------------------------------------------------------------- frames


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid = batch.column(0).to_numpy()
        texts = [t.as_buffer().to_pybytes() if t.as_buffer() else b"" for t in batch.column(1)]
        for i, at, h, c1, c2 in anchors(texts):
            yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(at.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in (h, c1, c2)]], ["uid", "at", "h", "c1", "c2"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = t.as_buffer().to_pybytes()
            before = [raw[max(0, p["at"] - LEFT) : p["at"]][::-1] for p in places]
            behind = [raw[p["at"] : p["at"] + LENGTH] for p in places]
            ids = [pa.array([p[c] for p in places], pa.int64()) for c in ("h", "c1", "c2")]
            first, last = [pa.array(x, pa.int32()) for x in ([LENGTH - len(b) for b in behind], [len(b) for b in before])]
            yield _swept(*ids, first, last, before, behind)


SWEPT = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("before", pa.binary()), ("behind", pa.binary()), ("done", pa.binary())])
SWEPT_SQL = "kind int, h long, c1 long, c2 long, lo int, hi int, before binary, behind binary, done binary"
#: Kinds of rows: bytes lo to hi around an anchor are repeated; windows that start lo to hi bytes
#: before the anchor are open; the window whose digest is ``before``, starting lo bytes before its
#: anchor, is open (c1, c2 null: known to be repeated, but a partner of others).
HIT, OPEN, WINDOW = 0, 1, 2


def _swept(h, c1, c2, lo, hi, before=None, behind=None, done=None, kind: int = OPEN) -> pa.RecordBatch:
    n = len(h)
    given = [[kind] * n, h, c1, c2, lo, hi, before, behind, done]
    return pa.RecordBatch.from_arrays([pa.array([None] * n if x is None else x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip(given, SWEPT, strict=True)], schema=SWEPT)


def _sweep(by_left: bool):
    """Rows come by h, a partition being a range of (h, bytes on the side it is dealt by). Whole groups
    are sorted, a few thousand rows at a time; a partition's first and last group may go on in others."""

    def solve(t: pa.Table, low_edge: bool, high_edge: bool) -> Iterator[pa.RecordBatch]:
        h, c1, c2, first, last = (t.column(c).to_numpy() for c in ("h", "c1", "c2", "lo", "hi"))
        before, behind = t.column("before").to_pylist(), t.column("behind").to_pylist()
        n = len(h)
        left = np.frombuffer(b"".join([b.ljust(LEFT, b"\0") for b in before]), np.uint8).reshape(n, LEFT)
        right = np.frombuffer(b"".join([b.ljust(LENGTH, b"\0") for b in behind]), np.uint8).reshape(n, LENGTH)
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
        hit, (by_right, r), (by_left_, l) = repeated(group, left, right, first, last)  # noqa: E741
        done = hit.copy()
        for i, d in enumerate(t.column("done").to_pylist()):
            if d is not None:
                done[i] |= np.unpackbits(np.frombuffer(d, np.uint8), count=LEFT + 1).astype(bool)
        row, start, end = runs(hit)
        if len(row):
            yield _swept(h[row], c1[row], c2[row], (1 - end).astype(np.int32), (LENGTH - start).astype(np.int32), kind=HIT)
        # how much each row of a group that is cut here has in common with the row at the border
        order, lcp, width = (by_left_, l, LEFT) if by_left else (by_right, r, LENGTH)
        reach = np.full(n, -1)
        if low_edge:
            k = int(np.searchsorted(group, 0, "right"))
            reach[order[:k]] = np.minimum.accumulate(np.concatenate(([width], lcp[1:k])))
        if high_edge:
            k = int(np.searchsorted(group, group[-1]))
            back = np.minimum.accumulate(np.concatenate(([width], lcp[k + 1 :][::-1])))[::-1]
            reach[order[k:]] = np.maximum(reach[order[k:]], back)
        lo, hi = (first, np.minimum(last, reach)) if by_left else (np.maximum(first, LENGTH - reach), last)
        rest = np.flatnonzero((reach >= 0) & (lo <= hi))
        if not len(rest):
            return
        if not by_left:
            for a in range(0, len(rest), ROWS):
                i = rest[a : a + ROWS]
                yield _swept(h[i], c1[i], c2[i], lo[i].astype(np.int32), hi[i].astype(np.int32), [before[x] for x in i], [behind[x] for x in i], [np.packbits(done[x]).tobytes() for x in i])
            return
        at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
        at_right[by_right], at_left[by_left_] = np.arange(n), np.arange(n)
        for o in range(int(lo[rest].min()), int(hi[rest].max()) + 1):
            here = rest[(lo[rest] <= o) & (o <= hi[rest])]
            if not len(here):
                continue
            key = np.cumsum(r < LENGTH - o)[at_right[here]] * (n + 1) + np.cumsum(l < o)[at_left[here]]
            i = here[np.unique(key, return_index=True)[1]]
            own = ~done[i, o]  # such a window is the only one of its kind here
            digest = [hashlib.md5(before[x][:o][::-1] + behind[x][: LENGTH - o]).digest() for x in i]
            yield _swept(h[i], pa.array(c1[i], mask=~own), pa.array(c2[i], mask=~own), [o] * len(i), [o] * len(i), digest, kind=WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        whole, size = True, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if cut:
                    yield from solve(t.slice(0, cut), whole, False)
                    whole = False
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if size:
            yield from solve(pa.Table.from_batches(held).combine_chunks(), whole, True)

    return run


SAMPLE_KEY = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def sweep(near: DataFrame, by_left: bool) -> DataFrame:
    """A written table of what a sort of all open rows in one order finds and leaves open."""
    spark = near.sparkSession
    size = near.agg(F.coalesce(F.sum(F.length("before") + F.length("behind") + 64), F.lit(0))).first()[0]
    # the hash at the end lets ranges part rows that are equal on this side
    dealt = near.repartitionByRange(tasks_for(spark, 2 * size), "h", "before" if by_left else "behind", "c2")
    # the keys are long: a smaller sample of them goes to the driver
    usual = spark.conf.get(SAMPLE_KEY)
    spark.conf.set(SAMPLE_KEY, "20")
    try:
        return written(dealt.sortWithinPartitions("h").mapInArrow(_sweep(by_left), SWEPT_SQL), "swept")
    finally:
        spark.conf.set(SAMPLE_KEY, usual)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """A written table (uid, spans): the byte spans (lo, hi) of distinct texts that
    repeated windows cover; they may overlap. Tables that no later step reads are deleted on the way."""
    found = written(texts.where(F.length(F.col("text").cast("binary")) >= LENGTH).select("uid", F.col("text").cast("binary").alias("text")).mapInArrow(_anchor_rows, "uid long, at long, h long, c1 long, c2 long"), "anchors")
    # written, so that a string on a large share of all rows can be split over tasks in the join
    often = written(found.groupBy("h").agg(F.count("*").alias("n"), F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "often")
    rows = written(found.join(often, "h"), "repeated")
    forget(found, often)
    kinds = written(rows.where("mixed").groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("place")), "kinds")
    places = kinds.select(F.col("place.uid").alias("uid"), F.struct(F.col("place.at").alias("at"), "h", "c1", "c2").alias("p")).groupBy("uid").agg(F.collect_list("p").alias("ps"))
    near = written(texts.select("uid", F.col("text").cast("binary").alias("text")).join(places, "uid").select("text", "ps").mapInArrow(_surroundings, SWEPT_SQL), "surroundings")
    # surroundings that occur twice are repeated as a whole, and so are all of a string that has one kind of them
    again = written(kinds.where("n > 1").select("h", "c1", "c2", F.lit(True).alias("again")), "again")
    forget(kinds)
    right = sweep(near, False)
    forget(near)
    left = sweep(right.where(F.col("kind") == OPEN), True)
    windows = left.where(F.col("kind") == WINDOW)
    many = windows.groupBy("lo", "before").agg(F.count("*").alias("n")).where("n > 1")
    rest = windows.where("c1 is not null").join(many, ["lo", "before"], "left_semi").select("h", "c1", "c2", (-F.col("lo")).alias("lo"), (LENGTH - F.col("lo")).alias("hi"))
    hits = union_all([t.where(F.col("kind") == HIT).select("h", "c1", "c2", "lo", "hi") for t in (right, left)] + [rest])
    spans = written(hits.groupBy("h", "c1", "c2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    forget(right, left)
    mixed = rows.where("mixed").join(again, ["h", "c1", "c2"], "left")
    whole = rows.where("not mixed").select("uid", "at").unionByName(mixed.where("again").select("uid", "at"))
    whole = whole.select("uid", F.greatest(F.lit(0), F.col("at") - LEFT).alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    some = mixed.where("again is null").join(spans, ["h", "c1", "c2"]).select("uid", "at", F.explode("spans").alias("s")).select("uid", (F.col("at") + F.col("s.lo")).alias("lo"), (F.col("at") + F.col("s.hi")).alias("hi"))
    out = written(whole.unionByName(some).groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "covered")
    forget(rows, spans, again)
    return out


def cut(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """Distinct texts with what stays of them: (key, kept binary, n_bytes, n_removed, n_spans);
    with ``whole_characters`` bytes of characters that a cut splits are left out of ``kept``.

    Null counts as empty. Texts under LENGTH bytes lose nothing; a text that
    another row repeats, of any doc_id, loses everything if it has LENGTH bytes.
    An empty table gives no rows. Other columns are not read.
    """
    texts = distinct_texts(docs)
    spans = repeated_spans(texts.select("uid", "text"))
    rows = texts.select("uid", "key", F.col("text").cast("binary").alias("text"), "copies").join(spans, "uid", "left").select("key", "text", "copies", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, n = [], [], [], []
            for t, copies, lo, hi in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                raw = t.as_buffer().to_pybytes() if t.as_buffer() else b""
                step = np.zeros(len(raw) + 1, np.int32)
                if copies > 1 and len(raw) >= LENGTH:
                    step[0] += 1
                elif lo.is_valid:
                    np.add.at(step, lo.values.to_numpy(), 1)
                    np.add.at(step, np.minimum(hi.values.to_numpy(), len(raw)), -1)
                dead = np.cumsum(step)[:-1] > 0
                rest = np.frombuffer(raw, np.uint8)[~dead].tobytes()
                kept.append(rest.decode("utf-8", "ignore").encode() if whole_characters else rest)
                sizes.append(len(raw))
                gone.append(int(dead.sum()))
                n.append(int((np.diff(dead.astype(np.int8), prepend=0) == 1).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64())], ["key", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(run, "key binary, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    by_key = cut(docs).select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(by_key, "key").drop("key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to what stays; all rows and columns stay.

    A null text stays null. Windows are bytes, so a cut may split a character;
    its broken bytes are left out of the text.
    """
    key, new = free_name(docs.columns, "key"), free_name(docs.columns, "new")
    fixed = cut(docs, whole_characters=True).where("n_removed > 0").select(F.col("key").alias(key), F.col("kept").cast("string").alias(new))
    rows = docs.withColumn(key, text_key(F.col("text"))).join(fixed, key, "left")
    text = F.when(F.col(new).isNotNull(), F.col(new)).otherwise(F.col("text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])
