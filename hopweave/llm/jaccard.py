"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct word shingles. Shingles are put in one global order,
rare ones first (by document frequency, then hash). If x and y are similar
enough, for every l their prefixes of |x| - o(x) + l and |y| - o(y) + l shingles
share at least l, o being the least overlap a set can have with any partner. A
longer prefix finds more texts but may ask for more matches, so each text takes
the l that minimises its estimated cost (frequencies of its prefix, plus the
verifications these leave); a pair is verified once it shares min(l, l') prefix
shingles.

How it is distributed:

* Frequencies. The hash range is cut into as many parts as the size of all texts
  asks for, each of about ``PART_BYTES`` of text. Tasks send each part one packet a
  batch of texts (seven bytes a shingle, and which text), through several levels of
  at most 2^``LEVEL_BITS`` branches where there are more parts. A part tells which
  of its shingles two texts or more have, and with them goes back everything that
  prefixes and overlaps need: a shingle found once can match nothing.
* Links. Texts meet in groups by a shared prefix shingle. A group of more than
  ``BLOCK`` texts or ``BLOCK_BYTES`` is dealt into blocks. First every text goes to its one most
  common prefix shingle; the links found there join most copies. Then only groups
  whose texts are not all connected yet are left; each text outside such a group's
  largest component meets all others of it, in pairs of blocks. No pair is ever a
  row: a task returns a spanning forest of the links it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import LOWER, chunks, components, distinct_texts, forget, free_name, joined, mix, prefix_hash, span_hash, tasks_for, text_key, word_spans, written

#: Least bits of the hash that name a part: the top byte of a shingle is told by it.
LEAST_BITS = 8
#: Bits that one level deals by, and bytes of text whose shingles one part holds, about.
LEVEL_BITS, PART_BYTES = 12, 8 << 20
#: Bytes of text in a packet, and shingles that a level gathers before it deals them on.
PACKET, GATHER = 2 << 20, 1 << 19
#: Texts and bytes of their shingles in a block.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Most prefix shingles asked for; it bounds the search for the cheapest prefix and changes no result.
LONGEST = 4
#: Bytes a kernel pass takes.
PASS = 1 << 17
#: Cost of a verification in scanned prefix entries.
VERIFY = 8.0


def shingles(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its sorted distinct shingles as 64-bit hashes) for whole texts."""
    for lo, hi in chunks([len(t) for t in texts], PASS):
        data, at = joined(texts[lo:hi])
        start, end = word_spans(data)
        words = span_hash(prefix_hash(LOWER[data]), start, end)
        first = np.searchsorted(start, at)
        n = len(words) - width + 1
        with np.errstate(over="ignore"):
            mul = np.uint64(0xD6E8FEB86659FD93)
            h = np.zeros(max(n, 0), np.uint64)
            for k in range(width):
                h = h * mul + words[k : k + len(h)]
            h = mix(h)
            for i in range(hi - lo):
                a, b = int(first[i]), int(first[i + 1])
                if b - a >= width:
                    yield lo + i, np.unique(h[a : b - width + 1])
                elif b > a:  # the whole sequence as one
                    one = np.uint64(b - a)
                    for w in words[a:b]:
                        one = one * mul + w
                    yield lo + i, mix(np.array([one], np.uint64))
                else:
                    yield lo + i, h[:0]


def _raw(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.as_buffer() else b"" for t in column]


@dataclass
class Packet:
    """Shingles of one part of the hash range, by the batches of texts they come from.

    ``count`` shingles in turn belong to the batch of texts whose first uid is
    ``base``; ``who`` is a text's number in its batch."""

    base: np.ndarray
    count: np.ndarray
    who: np.ndarray
    token: np.ndarray

    def packed(self) -> bytes:
        # steps between texts instead of their numbers: they compress well; the top byte is told by the part
        tail = np.ascontiguousarray(self.token.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
        step = np.diff(self.who.astype(np.int64), prepend=0).astype("<i4")
        return np.uint32(len(self.base)).tobytes() + self.base.astype("<i8").tobytes() + self.count.astype("<u4").tobytes() + step.tobytes() + tail.tobytes()

    @staticmethod
    def joined(datas: list[bytes], top: int) -> Packet:
        """All packets of a part with this top byte as one."""
        base, count, who, tail = [], [], [], []
        for d in datas:
            m = int(np.frombuffer(d, "<u4", 1)[0])
            base.append(np.frombuffer(d, "<i8", m, 4))
            count.append(np.frombuffer(d, "<u4", m, 4 + 8 * m))
            k = int(count[-1].sum())
            who.append(np.cumsum(np.frombuffer(d, "<i4", k, 4 + 12 * m)).astype(np.uint32))
            tail.append(np.frombuffer(d, np.uint8, 7 * k, 4 + 12 * m + 4 * k).reshape(-1, 7))
        full = np.empty((sum(map(len, tail)), 8), np.uint8)
        np.concatenate(tail, out=full[:, :7])
        full[:, 7] = top
        return Packet(np.concatenate(base), np.concatenate(count).astype(np.int64), np.concatenate(who), full.view("<u8").reshape(-1))

    def dealt(self, bits: int) -> Iterator[tuple[int, Packet]]:
        """By the part that the top ``bits`` bits of a shingle name."""
        part = (self.token >> np.uint64(64 - bits)).astype(np.int64)
        run = np.repeat(np.arange(len(self.base)), self.count)
        order = np.argsort(part, kind="stable")
        part, run, who, token = part[order], run[order], self.who[order], self.token[order]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            r = run[a:b]
            at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            yield int(part[a]), Packet(self.base[r[at]], np.diff(np.append(at, b - a)), who[a:b], token[a:b])


PACKETS = "part long, data binary"
#: The part of the rows that hold the sizes of sets.
SIZES = -1


def _rows(parts: list[int], datas: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(datas, pa.binary())], ["part", "data"])


def _packets(width: int, bits: int):
    """Rows (part, data): the shingles of a batch of texts in one part of the hash
    range; part SIZES has (base, numbers of the texts, sizes of their sets, their keys). uid = base + number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, key, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            # ids of one written file count on from its first
            starts = np.flatnonzero(np.concatenate(([True], uid[1:] >> 33 != uid[:-1] >> 33))).tolist()
            sizes = pa.compute.binary_length(texts).to_pylist()
            for s0, s1 in zip(starts, [*starts[1:], len(uid)], strict=True):
                for lo, hi in chunks(sizes[s0:s1], PACKET):
                    yield packet(uid[s0 + lo : s0 + hi], key[s0 + lo : s0 + hi], _raw(texts.slice(s0 + lo, hi - lo)))

    def packet(uid: np.ndarray, key: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        base = int(uid.min())
        sets = list(shingles(texts, width))
        index = (uid - base)[[i for i, _ in sets]]
        sizes = np.array([len(s) for _, s in sets], np.int64)
        tokens = np.concatenate([s for _, s in sets])
        whole = Packet(np.array([base]), np.array([len(tokens)]), np.repeat(index, sizes), tokens)
        dealt = [(p, x.packed()) for p, x in whole.dealt(bits)]
        return _rows([SIZES, *[p for p, _ in dealt]], [np.concatenate(([base], index, sizes)).astype("<i8").tobytes() + b"".join(key), *[d for _, d in dealt]])

    return run


def _dealt_on(before: int, bits: int):
    """The next level: packets (rows come by part, of ``before`` bits) by ``bits`` bits, a bounded number of shingles at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            dealt = list(Packet.joined(held, part >> (before - 8)).dealt(bits))
            return _rows([p for p, _ in dealt], [x.packed() for _, x in dealt])

        for batch in batches:
            for p, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p == SIZES:
                    yield _rows([p], [d.as_py()])
                    continue
                if held and (p != part or size >= 11 * GATHER):
                    yield flush()
                    held, size = [], 0
                part = p
                held.append(d.as_py())
                size += len(held[-1])
        if held:
            yield flush()

    return run


def _frequencies(bits: int):
    """One part after another (rows come by part): back to each batch of texts its shingles that
    two texts or more have, as (base, data = number u4 | frequency u4 | shingle u8), and the sizes."""

    def solve(part: int, datas: list[bytes]) -> pa.RecordBatch:
        got = Packet.joined(datas, part >> (bits - 8))
        order = np.argsort(got.token)
        s = got.token[order]
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        n = np.diff(edge)
        count = np.empty(len(s), "<u4")
        count[order] = np.repeat(n, n)
        del order, s
        live = count > 1
        ends = np.cumsum(got.count)
        kept = np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], ends))]
        who, count, token = got.who[live].astype("<u4"), count[live], got.token[live].astype("<u8")
        bases, out = [], []
        for base, a, b in zip(got.base.tolist(), kept[:-1].tolist(), kept[1:].tolist(), strict=True):
            if a < b:
                bases.append(base)
                out.append(who[a:b].tobytes() + count[a:b].tobytes() + token[a:b].tobytes())
        return answer(bases, False, out)

    def answer(bases: list[int], sizes: bool, out: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bases, pa.int64()), pa.array([sizes] * len(out), pa.bool_()), pa.array(out, pa.binary())], ["base", "sizes", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, datas = None, []
        for batch in batches:
            for p, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p == SIZES:
                    raw = d.as_py()
                    yield answer([int(np.frombuffer(raw, "<i8", 1)[0])], True, [raw[8:]])
                    continue
                if p != part and datas:
                    yield solve(part, datas)
                    datas = []
                part = p
                datas.append(d.as_py())
        if datas:
            yield solve(part, datas)

    return run


def overlap_least(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n can have with a similar one."""
    return (percent * n + 99) // 100


def choose(freq: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(l, prefix length among the shingles of frequency 2 and more, rarest first).

    Estimated cost: the entries that the prefix meets, and that many verifications
    at most one in l of them can lead to."""
    least = int(overlap_least(np.array(n), percent))
    alone = n - len(freq)
    best = (np.inf, 1, 0)
    met = np.concatenate(([0], np.cumsum(freq.astype(np.int64) - 1)))
    for l in range(1, min(LONGEST, least) + 1):  # noqa: E741
        p = min(max(0, n - least + l - alone), len(freq))
        cost = float(met[p]) * (1 + VERIFY / l)
        if cost < best[0]:
            best = (cost, l, p)
        if not met[p] and l == 1:
            break
    return best[1], best[2]


def _sets(percent: int):
    """Batches of texts (rows come by base) to (uid, n, l, w, p, prefix, tokens binary): the ``p``
    first of the ``w`` tokens are the prefix.

    Only texts with a prefix shingle that others have are kept: the rest link with nothing."""

    def solve(base: int, sizes: bytes, datas: list[bytes]) -> list[dict]:
        index, size, _ = _unpacked(sizes)
        n = dict(zip(index.tolist(), size.tolist(), strict=True))
        k = [len(d) // 16 for d in datas]
        who = np.concatenate([np.frombuffer(d, "<u4", m) for d, m in zip(datas, k, strict=True)])
        freq = np.concatenate([np.frombuffer(d, "<u4", m, 4 * m) for d, m in zip(datas, k, strict=True)])
        tokens = np.concatenate([np.frombuffer(d, "<u8", m, 8 * m) for d, m in zip(datas, k, strict=True)])
        order = np.lexsort((tokens, freq, who))
        who, freq, tokens = who[order], freq[order], tokens[order]
        edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True]))) if len(who) else [0]
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            i = int(who[a])
            l, p = choose(freq[a:b], n[i], percent)  # noqa: E741
            if p:
                out.append({"uid": base + i, "n": n[i], "l": l, "w": b - a, "p": p, "prefix": tokens[a : a + p].view("<i8").tolist(), "tokens": tokens[a:b].tobytes()})
        return out

    schema = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("l", pa.int32()), ("w", pa.int32()), ("p", pa.int32()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sizes, datas = None, b"", []
        for batch in batches:
            for b, is_size, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != base:
                    if datas and (rows := solve(base, sizes, datas)):
                        yield pa.RecordBatch.from_pylist(rows, schema)
                    base, datas = b, []
                if is_size:
                    sizes = d.as_py()
                else:
                    datas.append(d.as_py())
        if datas and (rows := solve(base, sizes, datas)):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def bits_for(n_bytes: int) -> int:
    """Bits that name a part, so that a part has the shingles of about PART_BYTES of text."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1, n_bytes) / PART_BYTES)))


def frequencies(texts: DataFrame, width: int) -> DataFrame:
    """A written table of what each batch of texts gets back from the parts of the hash range."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits, done = bits_for(size), min(LEVEL_BITS, bits_for(size))
    n = tasks_for(spark, 2 * size)
    sent = texts.select("uid", "key", F.col("text").cast("binary").alias("text")).mapInArrow(_packets(width, done), PACKETS)
    while done < bits:
        more = min(bits, done + LEVEL_BITS)
        sent = _by_part(sent, n).mapInArrow(_dealt_on(done, more), PACKETS)
        done = more
    return written(_by_part(sent, n).mapInArrow(_frequencies(bits), "base long, sizes boolean, data binary"), "frequencies")


def _by_part(sent: DataFrame, n: int) -> DataFrame:
    # parts in turn go to the tasks in turn: each gets as many; rows of sizes are small and go anywhere
    to = F.when(F.col("part") >= 0, F.pmod("part", F.lit(n))).otherwise(F.pmod(F.hash("data"), F.lit(n))).cast("int")
    return sent.repartitionById(n, to).sortWithinPartitions("part")


def _unpacked(sizes: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers, sizes and keys (16 bytes each) of a batch of texts."""
    m = len(sizes) // 32
    return np.frombuffer(sizes, "<i8", m), np.frombuffer(sizes, "<i8", m, 8 * m), [sizes[i : i + 16] for i in range(16 * m, 32 * m, 16)]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            index, size, key = _unpacked(d.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(base + index), pa.array(key, pa.binary()), pa.array(size)], ["uid", "key", "n_shingles"])


def sets(back: DataFrame, percent: int) -> DataFrame:
    """A written table (uid, n, l, w, p, prefix, tokens) of the texts that may have a
    partner; tokens are the shingles of frequency two and more, the prefix first."""
    size = back.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    rows = back.repartition(tasks_for(back.sparkSession, size), "base").sortWithinPartitions("base", F.desc("sizes"))
    return written(rows.mapInArrow(_sets(percent), "uid long, n long, l int, w int, p int, prefix array<bigint>, tokens binary"), "sets")


def forest(links: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric link matrix."""
    low = np.arange(len(links))
    while True:
        new = np.where(links, low[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(new, low)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def linked(tokens: list[np.ndarray], sizes: np.ndarray, prefixes: list[np.ndarray], need: np.ndarray, percent: int) -> np.ndarray:
    """Link matrix of a group: candidates share min(l, l') prefix shingles, then overlaps decide."""

    def shared(sets_: list[np.ndarray]) -> np.ndarray:
        m = len(sets_)
        flat = np.concatenate(sets_) if m else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(m), [len(s) for s in sets_])
        _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[col] > 1
        col, row = np.unique(col[keep], return_inverse=True)[1], row[keep]
        out = np.zeros((m, m), np.float32)
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        width = 2048
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            x = np.zeros((m, width), np.float32)
            x[row[a:b], col[a:b] - lo] = 1
            x = x[:, : int(col[b - 1]) - lo + 1] if b > a else x[:, :0]
            out += x @ x.T
        return out

    maybe = shared(prefixes) >= np.minimum(need[:, None], need[None, :])
    np.fill_diagonal(maybe, False)
    live = np.flatnonzero(maybe.any(1))
    out = np.zeros_like(maybe)
    if len(live):
        inter = np.rint(shared([tokens[i] for i in live])).astype(np.int64)
        total = sizes[live][:, None] + sizes[live][None, :]
        out[np.ix_(live, live)] = maybe[np.ix_(live, live)] & (100 * inter >= percent * (total - inter))
    return out


def _group_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        pdf = pdf.drop_duplicates("uid")
        if len(pdf) < 2 or pdf["comp"].nunique() < 2:
            return none
        uid, comp = pdf["uid"].to_numpy(), pdf["comp"].to_numpy()
        tokens = [np.frombuffer(t, "<u8") for t in pdf["tokens"]]
        prefixes = [t[:p] for t, p in zip(tokens, pdf["p"], strict=True)]
        links = linked(tokens, pdf["n"].to_numpy(), prefixes, pdf["l"].to_numpy(), percent)
        low = forest(links)
        at = np.flatnonzero(low != np.arange(len(low)))
        return pd.DataFrame({"a": uid[at], "b": uid[low[at]]})

    return run


def _meet(keys: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found among the texts of equal (token, i, j). keys: (uid, comp, token, i, j)."""
    return keys.join(own.select("uid", "n", "l", "p", "tokens"), "uid").groupBy("token", "i", "j").applyInPandas(_group_links(percent), "a long, b long")


def _blocks(texts: Column, width: Column, block: int) -> Column:
    """Blocks that a group of so many texts with so many tokens is dealt into."""
    return F.greatest(F.lit(1), F.ceil(texts / block), F.ceil(8 * width / BLOCK_BYTES)).cast("int")


def links(own: DataFrame, percent: int, block: int | None = None) -> DataFrame:
    """A written table of links (a, b) that connects exactly what all links connect."""
    block = block or BLOCK
    entry = own.select("uid", "w", F.explode("prefix").alias("token"))
    # sizes are written before they are joined, so that Spark may split the rows of a frequent shingle
    size = written(entry.groupBy("token").agg(F.count("*").alias("size"), F.sum("w").alias("width")).where("size > 1"), "sizes")
    old, entry = size, written(entry.join(size, "token"), "entries")
    forget(old)
    home = written(entry.groupBy("uid").agg(F.max(F.struct("size", "token", "width")).alias("home")).select("uid", F.col("uid").alias("comp"), "home.token", _blocks(F.col("home.size"), F.col("home.width"), block).alias("blocks")), "homes")
    dealt = lambda k: F.pmod(F.xxhash64(F.lit(k), "uid"), F.col("blocks")).cast("int").alias("i")
    found = written(_meet(home.select("uid", "comp", "token", dealt(0), F.lit(0).alias("j")), own, percent), "links")
    if not home.where("blocks > 1").isEmpty():
        # dealt anew, the blocks of a large group join
        again = _meet(home.where("blocks > 1").select("uid", "comp", "token", dealt(1), F.lit(1).alias("j")), own, percent)
        old, found = found, written(found.unionByName(again), "links")
        forget(old)
    forget(home)
    comp = written(components(found), "components")
    named = written(entry.join(comp.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "w", "token", F.coalesce("component", "uid").alias("comp")), "named")
    forget(entry, comp)
    parts = named.groupBy("token", "comp").agg(F.count("*").alias("m"), F.sum("w").alias("width"), F.bit_xor(F.xxhash64("uid")).alias("x"))
    groups = parts.groupBy("token").agg(F.sum("m").alias("size"), F.sum("width").alias("width"), F.count("*").alias("k"), F.max(F.struct("m", "comp", "width")).alias("top"), F.bit_xor("x").alias("x")).where("k > 1")
    # groups of the same texts are one
    groups = groups.groupBy("x", "size", "width").agg(F.min(F.struct("token", "top")).alias("g"))
    groups = written(groups.select("g.token", F.col("g.top.comp").alias("top"), _blocks(F.col("size"), F.col("width"), block).alias("n_in"), _blocks(F.col("size") - F.col("g.top.m"), F.col("width") - F.col("g.top.width"), block).alias("n_out")), "groups")
    rows = named.join(groups, "token")
    place = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # texts outside the largest component (blocks j) meet all texts (blocks i)
    outer = rows.where("comp <> top").select("uid", "comp", "token", place(F.col("n_out")).alias("j"), each("n_in").alias("i"))
    every = rows.select("uid", "comp", "token", place(F.col("n_in")).alias("i"), each("n_out").alias("j"))
    rest = _meet(outer.unionByName(every), own, percent)
    out = written(found.unionByName(rest), "links")
    forget(found, named, groups)
    return out


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A written table, per distinct text: (key, n_shingles, class long); ``class`` is null for texts
    without a word, which link with nothing, not even with their copies."""
    texts = distinct_texts(docs)
    # each large table goes as soon as the next one stands
    back = frequencies(texts, width)
    forget(texts)
    sized = written(back.where("sizes").select("base", "data").mapInArrow(_sizes, "uid long, key binary, n_shingles long"), "sizes")
    own = sets(back, percent)
    forget(back)
    found = links(own, percent)
    forget(own)
    of = written(components(found), "components")
    named = sized.join(of.withColumnRenamed("node", "uid"), "uid", "left")
    out = written(named.select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "uid")).alias("class")), "classes")
    forget(sized, found, of)
    return out


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included).

    Null and blank texts have no set and link with nothing. Rows of equal text are
    linked. A null doc_id never is a component's name unless all of it are null.
    """
    of = classes(docs, width, percent)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(of, "key")
    # written, so that rows of a large class may be split over tasks in the join
    low = written(rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low")), "lowest")
    return rows.join(low, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (nulls
    last; of equal ids the one that comes first by hashes of text and row, one of
    rows that are the same throughout). Rows without a word all stay.

    The choice is made on ids and hashes; each text is shuffled once.
    """
    key, row = free_name(docs.columns, "key"), free_name(docs.columns, "row")
    of = classes(docs, width, percent)
    marked = docs.withColumns({key: text_key(F.col("text")), row: F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])})
    narrow = marked.select(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"), F.col(row).alias("row"))
    # one row a text before anything is joined, so that its copies never meet in a task
    times = narrow.groupBy("key", "none", "id", "row").agg(F.count("*").alias("times"))
    texts = times.groupBy("key").agg(F.min(F.struct("none", "id", "row", "times")).alias("m")).select("key", "m.*")
    named = texts.join(of.where(F.col("class").isNotNull()), "key")
    first = named.groupBy("class").agg(F.min(F.struct("none", "id", "key", "row", "times")).alias("m"))
    stay = written(first.select("m.key", "m.row", "m.times"), "stay")
    forget(of)
    flag = free_name([*docs.columns, key, row], "stays")
    blank = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    kept = marked.join(stay.select(F.col("key").alias(key), F.col("row").alias(row), F.lit(True).alias(flag)), [key, row], "left").where(blank | F.col(flag))
    if not stay.where("times > 1").isEmpty():
        kept = kept.where(~blank).dropDuplicates([key, row]).unionByName(kept.where(blank))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
