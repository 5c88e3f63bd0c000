"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has an edge for every vocabulary piece that matches at a
place, and for a character without one an edge of its bytes. A segmentation
scores the sum of its pieces' scores. A forward Viterbi pass gives each place
its best prefix score; these are exact heuristics for an A* search from the end
backwards, which yields complete segmentations in order of score.

Two exact decompositions keep whole corpora affordable. No piece joins two
characters that are adjacent in no piece, so a text is cut there (in practice
before every space mark, and before a final comma or stop) and the lattice is a
chain of segment lattices, each solved once per distinct segment. A segmentation among the N best
departs from the best one only in segments whose own second best costs least:
N - 1 of them, found without any search as the best path through an edge that is
not on the best path. The A* search then runs over the lattice of just these
segments, the others staying at their best.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.common import binaries, chunks, distinct_chunks, prefix_hash, span_hash, text_bytes

MARK = "▁"
#: Stands for a space mark that is in the text itself, which is stored as its bytes; a
#: lone surrogate, so no valid text has it.
LITERAL = "\udfff"
UNKNOWN_PENALTY = 10.0
#: Segments longer than this are solved one at a time, in memory linear in their length; by
#: the same rules, so it changes no result.
WIDE = 48
#: Bytes a kernel pass takes, and segments the memo holds; neither changes a result.
PASS, MEMO = 1 << 19, 250_000


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_id = {}
        self.raw: list[bytes] = []
        names: dict[str, int] = {}
        scores = []
        for i in range(n):
            p = sp.id_to_piece(i)
            scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.bytes_id[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                names[p] = i
                self.raw.append(p.replace(MARK, " ").encode())
        if len(self.bytes_id) < 256:
            raise ValueError("the model has no byte pieces")
        self.ids = names
        self.scores = np.array(scores)
        usual = [scores[i] for i in names.values() if scores[i] > -1e8]
        self.unknown = min(usual) - UNKNOWN_PENALTY
        self.longest = max(map(len, names))
        self.pairs = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        #: bytes (any of a longer character counts as such) that a stop or comma may share a piece with
        self.joins = {}
        for stop in ".,":
            before = {q[0] for q in self.pairs if q[1] == stop}
            self.joins[ord(stop)] = np.array([chr(b) in before if b < 128 else any(ord(c) > 127 for c in before) for b in range(256)])
        #: cuts before each space mark are exact if no piece has one behind another character
        self.by_space = not any(q[1] == MARK != q[0] for q in self.pairs)
        hashes = np.array([self._hash(p) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_ids = np.array(list(names.values()))[order]
        self.slots = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.depth = int(np.bincount((self.hashes >> np.uint64(48)).astype(np.int64)).max())

    @staticmethod
    def _hash(text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return span_hash(prefix_hash(codes), np.array([0]), np.array([len(codes)]))[0]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids by hash, -1 where there is none."""
        at = self.slots[(h >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        for k in range(self.depth):
            i = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[i] == h
            out[hit] = self.hash_ids[i[hit]]
        return out

    def edge_ids(self, text: str) -> list[int]:
        """Ids of an edge: the piece, or the bytes of a character that is none."""
        i = self.ids.get(text)
        if i is not None:
            return [i]
        return [self.bytes_id[b] for b in (MARK if text == LITERAL else text).encode()]

    def edges(self, text: str, end: int) -> Iterator[tuple[int, float]]:
        """(start, score) of the edges that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(text[start:end])
            if i is not None:
                yield start, float(self.scores[i])
            elif start == end - 1:
                yield start, self.unknown


def lattice(vocab: Vocabulary, parts: list[str]) -> list[list[tuple[int, float]]]:
    """For each place of the joined parts, (start, score) of the edges that end there; none crosses parts."""
    out: list[list[tuple[int, float]]] = [[]]
    for part in parts:
        base = len(out) - 1
        out += [[(base + s, w) for s, w in vocab.edges(part, end)] for end in range(1, len(part) + 1)]
    return out


def a_star(vocab: Vocabulary, parts: list[str], n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations as (score, places), best first. Hypotheses of
    equal score leave in the order they were made, so results are deterministic."""
    edges = lattice(vocab, parts)
    best = [0.0]
    for here in edges[1:]:
        best.append(max([best[s] + w for s, w in here]))
    made = 0
    heap = [(-best[-1], made, 0.0, len(edges) - 1, None)]
    out = []
    while heap and len(out) < n:
        _, _, suffix, at, path = heapq.heappop(heap)
        if at == 0:
            places = [0]
            while path is not None:
                places.append(path[0])
                path = path[1]
            out.append((suffix, places))
            continue
        for start, w in edges[at]:
            made += 1
            heapq.heappush(heap, (-(best[start] + w + suffix), made, w + suffix, start, (at, path)))
    return out


def marked(segment: bytes) -> str:
    """A segment's characters as pieces have them."""
    return segment.decode().replace(MARK, LITERAL).replace(" ", MARK)


def unmarked(segment: str) -> bytes:
    return segment.replace(MARK, " ").replace(LITERAL, MARK).encode()


class Numbers(dict):
    """Segments' numbers by their bytes in the text, found by their marked characters too."""

    def __missing__(self, segment: bytes | str) -> int:
        if isinstance(segment, str):
            return self[unmarked(segment)]
        raise KeyError(segment)


class Solver:
    """Memo of distinct segments: ids of the best segmentation, its score, and what the second best costs more."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        #: ids of segment k: flat[ends[k]:ends[k + 1]]
        self.flat = np.zeros(0, "<u4")
        self.ends = np.zeros(1, np.int64)
        self.score = [np.zeros(0)]
        self.gap = [np.zeros(0)]
        self.new: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def ids(self) -> pa.LargeBinaryArray:
        """Each segment's ids as little-endian u32 bytes."""
        return binaries(self.flat, 4 * self.ends)

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where no piece can cross, in texts that all begin with the space that stands for the start."""
        first = ends[:-1][np.diff(ends) > 0]
        cut = np.zeros(len(data), bool)
        if self.v.by_space:
            space = data == 32
            cut[1:] = space[1:] & ~space[:-1]
            last = np.append(space[1:], True)
            last[first[1:] - 1] = True
            for stop, joins in self.v.joins.items():
                at = np.flatnonzero(last & (data == stop))
                at = at[at > 0]
                cut[at[~space[at - 1] & ~joins[data[at - 1]]]] = True
        cut[first] = True
        return np.append(np.flatnonzero(cut), len(data))

    def _one(self, text: str) -> tuple[bytes, float, float]:
        got = self._linear(text)
        places, ids = got[0][1], []
        for a, b in zip(places[:-1], places[1:], strict=True):
            ids += self.v.edge_ids(text[a:b])
        return np.array(ids, "<u4").tobytes(), got[0][0], got[0][0] - got[1][0] if len(got) > 1 else np.inf

    def _linear(self, text: str) -> list[tuple[float, list[int]]]:
        """What ``_many`` does for one segment of any length, in the same order and with
        the same rule for ties (the later start); edges are looked up again instead of kept."""
        n = len(text)
        alpha, back = [0.0], [0]
        for end in range(1, n + 1):
            s, w = max(self.v.edges(text, end), key=lambda e: (alpha[e[0]] + e[1], e[0]))
            alpha.append(alpha[s] + w)
            back.append(s)
        beta = [-np.inf] * n + [0.0]
        for end in range(n, 0, -1):
            for s, w in self.v.edges(text, end):
                beta[s] = max(beta[s], w + beta[end])
        places = [n]
        while places[-1]:
            places.append(back[places[-1]])
        places.reverse()
        on = set(zip(places[:-1], places[1:], strict=True))
        second = max((alpha[s] + w + beta[end] for end in range(1, n + 1) for s, w in self.v.edges(text, end) if (s, end) not in on), default=-np.inf)
        return [(alpha[n], places)] + [(second, [])] * (second > -np.inf)

    def learn(self, missing: list[str]) -> None:
        short = [m for m in missing if len(m) <= WIDE]
        for lo, hi in ((1, 6), (7, 10), (11, 16), (17, 28), (29, WIDE)):
            part = [m for m in short if lo <= len(m) <= hi]
            step = min(20_000, 320_000 // hi)
            for a in range(0, len(part), step):
                self._many(part[a : a + step])
        for m in missing:
            if len(m) > WIDE:
                ids, score, gap = self._one(m)
                self._put([m], np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]), np.array([score]), np.array([gap]))
        words, ids, sizes, score, gap = zip(*self.new, strict=True)
        self.new.clear()
        names = [unmarked(w) for part in words for w in part]
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.flat = np.concatenate((self.flat, *ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))))
        self.score, self.gap = [np.concatenate((*self.score, *score))], [np.concatenate((*self.gap, *gap))]

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        """Solved segments, their ids one behind the other."""
        self.new.append((words, ids, sizes, score, gap))

    def _many(self, words: list[str]) -> None:
        """Forward and backward Viterbi over many short segments at once."""
        if not words:
            return
        lens = np.array([len(w) for w in words])
        n, wide = len(words), int(lens.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.concatenate(([0], np.cumsum(lens)[:-1]))
        prefix = prefix_hash(codes)
        row = np.repeat(np.arange(n), lens)
        col = np.arange(len(codes)) - start[row]
        room = lens[row] - col
        low, top = -1e300, min(self.v.longest, wide)
        # all tables are (place, segment): a step reads whole rows
        alpha, beta = np.full((wide + 1, n), low), np.full((wide + 1, n), low)
        alpha[0] = 0
        piece, cost = np.full((top, wide + 1, n), -1, np.int32), np.full((top, wide + 1, n), -np.inf)
        for k in range(1, top + 1):
            at = np.flatnonzero(room >= k)
            got = self.v.lookup(span_hash(prefix, at, at + k))
            hit = got >= 0
            r, c = row[at[hit]], col[at[hit]]
            piece[k - 1, c, r] = got[hit]
            cost[k - 1, c, r] = self.v.scores[got[hit]]
            if k == 1:
                none = at[~hit]
                cost[0, col[none], row[none]] = self.v.unknown
        back = np.zeros((wide + 1, n), np.int8)
        for t in range(1, wide + 1):
            for k in range(1, min(top, t) + 1):
                s = alpha[t - k] + cost[k - 1, t - k]
                better = s > alpha[t]
                np.copyto(alpha[t], s, where=better)
                np.copyto(back[t], np.int8(k), where=better)
        rows = np.arange(n)
        beta[lens, rows] = 0
        for t in range(wide - 1, -1, -1):
            for k in range(1, min(top, wide - t) + 1):
                np.maximum(beta[t], cost[k - 1, t] + beta[t + k], out=beta[t])
        on = np.zeros((wide + 1, n), np.int8)
        at, steps = lens.copy(), []
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            k = back[at[live], live]
            on[at[live], live] = k
            at[live] -= k
            ids = np.full(n, -2, np.int64)
            ids[live] = piece[k - 1, at[live], live]
            steps.append((ids, at.copy()))
        second = np.full(n, -np.inf)
        for k in range(1, top + 1):
            for t in range(k, wide + 1):
                s = alpha[t - k] + cost[k - 1, t - k] + beta[t]
                s[on[t] == k] = -np.inf
                np.maximum(second, s, out=second)
        second[second < -1e200] = -np.inf
        final = alpha[lens, rows]
        path = np.stack([s[0] for s in reversed(steps)], 1)
        place = np.stack([s[1] for s in reversed(steps)], 1)
        odd = (path == -1).any(1)
        plain = np.flatnonzero(~odd)
        clean = path[plain]
        self._put([words[i] for i in plain.tolist()], clean[clean >= 0].astype("<u4"), (clean >= 0).sum(1), final[plain], (final - second)[plain])
        for i in np.flatnonzero(odd).tolist():
            out: list[int] = []
            for p, a in zip(path[i].tolist(), place[i].tolist(), strict=True):
                out += [p] if p >= 0 else self.v.edge_ids(words[i][a]) if p == -1 else []
            self._put([words[i]], np.array(out, "<u4"), np.array([len(out)]), final[i : i + 1], (final - second)[i : i + 1])

    def solve(self, texts: list[str], n: int) -> list[tuple[bytes, list[float]]]:
        """(ids of the best, the n best scores) of each whole text."""
        return [(ids[0] if ids else b"", scores) for ids, scores in self.solve_all(texts, n)]

    def solve_all(self, texts: list[str] | pa.Array, n: int) -> list[tuple[list[bytes], list[float]]]:
        """(ids of the n best, their scores) of each whole text; empty lists for null and empty ones."""
        rows = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, ends = text_bytes(rows)
        if not len(data):
            return [([], []) for _ in range(len(rows))]
        if len(self.at) > MEMO:
            self.clear()
        # a space before each text that is not empty stands for its start
        some = np.diff(ends) > 0
        data = np.insert(data, ends[:-1][some], 32)
        ends = ends + np.concatenate(([0], np.cumsum(some)))
        cut = self.cuts(data, ends)
        chunk, number = distinct_chunks(data, cut)
        missing = [c for c in chunk if c not in self.at]
        if missing:
            self.learn([marked(c) for c in missing])
        at = np.fromiter(map(self.at.__getitem__, chunk), np.int64, len(chunk))[number]
        found = self.ids.take(pa.array(at))
        to, raw = np.frombuffer(found.buffers()[1], np.int64), found.buffers()[2].to_pybytes()
        score, gap = self.score[0][at], self.gap[0][at]
        out: list[tuple[list[bytes], list[float]]] = []
        for lo, hi in pairwise(np.searchsorted(cut, ends).tolist()):
            if lo == hi:
                out.append(([], []))
                continue
            part = lambda i: marked(chunk[number[lo + i]])  # noqa: B023, E731
            out.append(self.n_best(part, raw, to[lo : hi + 1], gap[lo:hi], float(score[lo:hi].sum()), n))
        return out

    def n_best(self, part: Callable[[int], str], raw: bytes, to: np.ndarray, gaps: np.ndarray, best: float, n: int) -> tuple[list[bytes], list[float]]:
        """Ids and scores of the n best whole segmentations; the best of part i is raw[to[i]:to[i + 1]]."""
        whole = raw[to[0] : to[-1]]
        if n < 2:
            return [whole], [best][:n]
        if len(gaps) > n - 1:
            # of equal gaps the first
            near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2])
            near = near[np.argsort(gaps[near], kind="stable")[: n - 1]]
        else:
            near = np.arange(len(gaps))
        near = [i for i in np.sort(near).tolist() if np.isfinite(gaps[i])]
        if not near:
            return [whole], [best]
        chosen = [part(i) for i in near]
        found = a_star(self.v, chosen, n)
        own = [raw[to[i] : to[i + 1]] for i in near]
        # of equal scores A* may put another first, or even have n others; the best stays the best
        others = [x for x in (self._by_part(chosen, places) for _, places in found) if x != own][: len(found) - 1]
        fixed = [raw[to[a + 1] : to[b]] for a, b in zip([-1, *near], [*near, len(gaps)], strict=True)]
        rest = [fixed[0] + b"".join([x + f for x, f in zip(xs, fixed[1:], strict=True)]) for xs in others]
        return [whole, *rest], [best + (s - found[0][0]) for s, _ in found]

    def _by_part(self, parts: list[str], places: list[int]) -> list[bytes]:
        """Ids of each part under a segmentation of the joined parts."""
        text, out, ids, end, k = "".join(parts), [], [], len(parts[0]), 0
        for a, b in zip(places[:-1], places[1:], strict=True):
            ids += self.v.edge_ids(text[a:b])
            if b == end:
                out.append(np.array(ids, "<u4").tobytes())
                ids, k = [], k + 1
                end += len(parts[k]) if k < len(parts) else 0
        return out


_SOLVERS: dict[str, Solver] = {}


def solver(path: str) -> Solver:
    if path not in _SOLVERS:
        _SOLVERS[path] = Solver(Vocabulary(path))
    return _SOLVERS[path]


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The exact text of any encoding of it."""
    return b"".join(map(vocab.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def same_bytes(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two encodings stand for the same bytes; only what lies between their common ends is decoded."""
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    lo = int(differ.argmax()) if differ.any() else m
    differ = a[len(a) - m + lo :][::-1] != b[len(b) - m + lo :][::-1]
    hi = int(differ.argmax()) if differ.any() else m - lo
    of = lambda x: b"".join(map(vocab.raw.__getitem__, x[lo : len(x) - hi].tolist()))
    return of(a) == of(b)


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, model: str, n: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int>, best_score double, n_best array<double>
    (scores of the n best segmentations, fewer where there are no more) and
    alternatives array<array<int>> (ids of those behind the best, in the same order).

    Null and empty texts have no ids, a null score and empty lists. All rows
    stay; columns of these names (in any letter case) are replaced; whole texts of any length are
    encoded.
    """
    keep = [c for c in docs.columns if c.lower() not in ("ids", "best_score", "n_best", "alternatives")]
    at = keep.index(text)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("best_score", T.DoubleType()), T.StructField("n_best", T.ArrayType(T.DoubleType())), T.StructField("alternatives", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = solver(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for lo, hi in chunks(sizes, PASS):
                part = batch.slice(lo, hi - lo)
                got = s.solve_all(part.column(at), n)
                ids = _lists([g[0][0] if g[0] else b"" for g in got])
                ends = np.concatenate(([0], np.cumsum([len(g[0][1:]) for g in got]))).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), _lists([x for g in got for x in g[0][1:]]))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([g[1][0] if g[1] else None for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.float64())), others], [*batch.schema.names, "ids", "best_score", "n_best", "alternatives"])

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """Decode ``encode`` rows again: doc_id, n_pieces, best_score, n_best, ids_crc32,
    whether every segmentation decodes to the text (null as empty), and n_pieces
    and ids_crc32 of the alternatives."""
    cols = ["doc_id", "text", "ids", "best_score", "n_best", "alternatives"]
    added = "other_pieces array<long>, other_crc32 array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = solver(model).v
        for batch in batches:
            n, crc, same, more, sums = [], [], [], [], []
            for t, ids, others in zip(batch.column(1), batch.column(2), batch.column(5), strict=True):
                all_ = [x.values.to_numpy() for x in (ids, *others)]
                sizes, crcs = [len(x) for x in all_], [zlib.crc32(x.astype("<u4").tobytes()) for x in all_]
                n.append(sizes[0])
                crc.append(crcs[0])
                more.append(sizes[1:])
                sums.append(crcs[1:])
                same.append(decode(v, all_[0]) == (t.as_py() or "") and all(same_bytes(v, all_[0], x) for x in all_[1:]))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(3), batch.column(4), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(more, many), pa.array(sums, many)], ["doc_id", "n_pieces", "best_score", "n_best", "ids_crc32", "round_trip", "other_pieces", "other_crc32"])

    return encoded.select(*cols).mapInArrow(run, f"doc_id long, n_pieces long, best_score double, n_best array<double>, ids_crc32 long, round_trip boolean, {added}")
