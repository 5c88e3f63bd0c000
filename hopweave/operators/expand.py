"""Variable-length expansion.

A layer k holds the (start, target) pairs that a walk of k steps joins. With path
"any", layers may repeat pairs of earlier ones; with "shortest" they hold only pairs
not met before. The loop runs on the driver, one stored layer a step.

Two forms give the same results. "pairs" keeps one row a pair. "bits" keeps one row
a target and 64 starts, whose bits are merged by ``bit_or`` map-side, so frontiers
that many starts share shrink up to 64 times before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.graph import dense_ids
from hopweave.storage import counted, stored

#: Starts from which "auto" takes the bit-packed form, for at least so many steps.
BITS_FROM, BITS_STEPS = 1024, 2
#: Packed words that a task of ``bit_counts`` is expected to merge.
TASK_WORDS = 1 << 21
#: Cap on the hops of ``find_shortest``.
MAX_HOPS = 50


def _steps(steps: DataFrame | list[DataFrame], k_max: int) -> list[DataFrame]:
    if isinstance(steps, DataFrame):
        return [steps] * k_max
    if len(steps) == 1:
        return steps * k_max
    if len(steps) < k_max:
        raise ValueError(f"{k_max} steps need as many edge sets, {len(steps)} given")
    return steps[:k_max]


def layers(starts: DataFrame, steps: DataFrame | list[DataFrame], k_max: int, path: str = "any") -> list[DataFrame]:
    """Layers 0..k as (s, v); stops early once a layer is empty. ``starts``: distinct ids in column s."""
    out = [stored(starts.select("s", F.col("s").alias("v")), "layer")]
    for e in _steps(steps, k_max):
        nxt = out[-1].join(e, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"))
        if path == "shortest":
            # pairs met before are told by the same exchange that makes the new ones distinct
            old = reduce(DataFrame.union, out).withColumn("new", F.lit(False))
            nxt = nxt.withColumn("new", F.lit(True)).union(old).groupBy("s", "v").agg(F.min("new").alias("new")).where("new").drop("new")
        else:
            nxt = nxt.distinct()
        nxt, n = counted(nxt, "layer")
        if not n:
            break
        out.append(nxt)
    return out


def reached(starts: DataFrame, start: str, steps: DataFrame | list[DataFrame], k_max: int) -> DataFrame:
    """(v): every vertex within ``k_max`` steps of any start, the starts included. One frontier for
    all starts, so the work does not depend on how many there are."""
    out = [stored(starts.select(F.col(start).alias("v")).where("v is not null").distinct(), "reached")]
    for e in _steps(steps, k_max):
        old = reduce(DataFrame.union, out).withColumn("new", F.lit(False))
        nxt = out[-1].join(e, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), F.lit(True).alias("new"))
        nxt, n = counted(nxt.union(old).groupBy("v").agg(F.min("new").alias("new")).where("new").drop("new"), "reached")
        if not n:
            break
        out.append(nxt)
    return reduce(DataFrame.union, out)


def bit_layers(starts: DataFrame, steps: DataFrame | list[DataFrame], k_max: int, path: str = "any") -> tuple[DataFrame, list[DataFrame]]:
    """(numbered starts (s, i), layers as (v, w, bits)); bit i % 64 of word i / 64 is start i."""
    # numbered by order, as starts near each other are often reached together and then share words
    named = stored(dense_ids(starts.select(F.col("s").alias("id"))).select(F.col("id").alias("s"), F.col("rank").alias("i")), "starts")
    word, bit = F.shiftright("i", 6), F.expr("shiftleft(1L, cast(i & 63 as int))")
    front = named.select(F.col("s").alias("v"), word.alias("w"), bit.alias("bits"))
    out = [stored(front.groupBy("v", "w").agg(F.bit_or("bits").alias("bits")), "layer")]
    for e in _steps(steps, k_max):
        nxt = out[-1].join(e, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "w", "bits")
        if path == "shortest":
            # one exchange merges the new bits and takes those met before out of them
            none = F.lit(0).cast("long")
            old = reduce(DataFrame.union, out).select("v", "w", none.alias("bits"), F.col("bits").alias("old"))
            both = nxt.withColumn("old", none).union(old).groupBy("v", "w").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
            nxt = both.select("v", "w", F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")
        else:
            nxt = nxt.groupBy("v", "w").agg(F.bit_or("bits").alias("bits"))
        nxt, n = counted(nxt, "layer")
        if not n:
            break
        out.append(nxt)
    return named, out


def unpacked(named: DataFrame, bits: DataFrame) -> DataFrame:
    """(s, v) of a bit layer."""
    rows = bits.select("v", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).where("getbit(bits, k) = 1")
    return rows.select("v", (F.shiftleft("w", 6) + F.col("k")).alias("i")).join(named, "i").select("s", "v")


def expand(
    starts: DataFrame,
    start: str,
    target: str,
    steps: DataFrame | list[DataFrame],
    k_min: int = 1,
    k_max: int = 1,
    path: str = "any",
    distance: str | None = None,
    strategy: str = "auto",
    distinct_starts: bool = False,
    targets: DataFrame | None = None,
) -> DataFrame:
    """(start, target[, distance]) of walks of k_min to k_max steps from ``starts[start]``.

    ``steps``: the (src, dst) pairs of every step, or a list with those of each.
    ``path``: "any" (vertices and edges may repeat) or "shortest" (breadth first).
    ``distance``: None; "all" gives a row for each length that joins a pair;
    "min" the least length in range. Start rows are a bag: a start that occurs
    twice has its results twice, unless ``distinct_starts`` says there are none.
    k_min = 0 includes (s, s). Null starts have no result; other columns are dropped.
    ``targets``: one column of ids; only pairs that end in one are given, and the last
    step walks no other edges.
    """
    if k_min < 0 or k_max < k_min or path not in ("any", "shortest") or distance not in (None, "all", "min"):
        raise ValueError("0 <= k_min <= k_max; path any or shortest; distance None, all or min")
    rows = starts.select(F.col(start).alias("s")).where("s is not null")
    base = rows if distinct_starts else rows.distinct()
    if strategy == "auto":
        strategy = "bits" if k_max >= BITS_STEPS and base.limit(BITS_FROM).count() == BITS_FROM else "pairs"
    if targets is not None:
        ends = targets.select(F.col(targets.columns[0]).alias("dst")).distinct()
        by_step = _steps(steps, k_max)
        steps = [*by_step[:-1], by_step[-1].join(ends, "dst", "left_semi").select("src", "dst")] if by_step else steps
        end = lambda d: d.join(ends.withColumnRenamed("dst", "v"), "v", "left_semi").select("s", "v")
    else:
        end = lambda d: d
    if strategy == "bits":
        named, packed = bit_layers(base, steps, k_max, path)
        if distance is None and path == "any" and k_min < len(packed):
            one = reduce(DataFrame.union, packed[k_min:]).groupBy("v", "w").agg(F.bit_or("bits").alias("bits"))
            found, got = {}, end(unpacked(named, one))
        else:
            found = {k: end(unpacked(named, b)) for k, b in enumerate(packed) if k >= k_min}
    elif strategy == "pairs":
        found = {k: end(d) for k, d in enumerate(layers(base, steps, k_max, path)) if k >= k_min}
    else:
        raise ValueError(f"no strategy {strategy}")
    if strategy == "pairs" or found or k_min >= len(packed):
        parts = [d.withColumn("k", F.lit(k)) for k, d in found.items()] or [base.select("s", F.col("s").alias("v"), F.lit(0).alias("k")).where("false")]
        got = reduce(DataFrame.union, parts)
        if path == "any" and len(parts) > 1 and distance != "all":
            got = got.groupBy("s", "v").agg(F.min("k").alias("k"))
    if not distinct_starts:
        got = rows.join(got, "s")
    out = [F.col("s").alias(start), F.col("v").alias(target)]
    return got.select(*out, *([F.col("k").alias("distance")] if distance else []))


def bit_counts(starts: DataFrame, start: str, steps: DataFrame | list[DataFrame], k_min: int, k_max: int, path: str = "any") -> DataFrame:
    """(v, n): how many distinct starts reach each target, counted on packed words without listing the pairs.

    The last layer, the largest, is never stored: each vertex sends its words as one array along its
    edges, and one exchange by target merges and counts them."""
    if isinstance(steps, DataFrame) and k_max > 1:
        steps = stored(steps, "edges")
    by_step = _steps(steps, k_max)
    _, packed = bit_layers(starts.select(F.col(start).alias("s")).where("s is not null").distinct(), by_step[:-1], max(k_max - 1, 0), path)
    n = F.sum(F.bit_count("bits")).alias("n")
    if not 0 < k_max <= len(packed):
        chosen = packed[k_min:] or [packed[0].where("false")]
        return reduce(DataFrame.union, chosen).groupBy("v", "w").agg(F.bit_or("bits").alias("bits")).groupBy("v").agg(n)
    # a long holds the number of half a word above its 32 bits
    low, high = F.shiftleft("w", 33).bitwiseOR(F.expr("bits & 4294967295L")), F.shiftleft("w", 33).bitwiseOR(F.lit(1 << 32)).bitwiseOR(F.shiftrightunsigned("bits", 32))
    halves, some = F.array(low, high).alias("halves"), "(half & 4294967295L) <> 0"
    front = packed[-1].select("v", F.explode(halves).alias("half")).where(some).groupBy("v").agg(F.collect_list("half").alias("halves"))
    sent = [front.join(by_step[-1], F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "halves")]
    # with "shortest", pairs of all earlier layers are no new ones; those below k_min are counted off again
    sent += [d.select("v", halves) for d in (packed if path == "shortest" else packed[k_min:])]
    sizes = [d.count() for d in packed[-2:]]
    parts = max(int(packed[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes[-1] ** 2 // (sizes[0] or 1)) // TASK_WORDS)
    got = reduce(DataFrame.union, sent).repartition(parts, "v").select("v", F.explode("halves").alias("half")).where(some)
    merged = got.groupBy("v", F.shiftright("half", 32).alias("w")).agg(F.bit_or(F.expr("half & 4294967295L")).alias("bits"))
    out = merged.groupBy("v").agg(n)
    if path == "shortest" and k_min:
        off = reduce(DataFrame.union, packed[:k_min]).groupBy("v").agg(F.sum(F.bit_count("bits")).alias("off"))
        out = out.join(off, "v", "left").select("v", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n")).where("n > 0")
    return out


def neighbours(starts: DataFrame, start: str, target: str, step: DataFrame, distance: bool = False) -> DataFrame:
    """One hop: (start, target[, distance = 1]), a row for each start row and distinct neighbour."""
    out = starts.select(F.col(start).alias("s")).join(step.distinct(), F.col("s") == F.col("src")).select(F.col("s").alias(start), F.col("dst").alias(target))
    return out.withColumn("distance", F.lit(1)) if distance else out


def find_shortest(pairs: DataFrame, start: str, target: str, step: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """``pairs`` (exactly start and target; rows stay as they are, repeated ones too) with
    ``distance``: 0 if equal, hops if reached within ``max_hops``, else -1. A null end is never reached."""
    rows = pairs.select(F.col(start).alias("s"), F.col(target).alias("t"))
    asked = stored(rows.where("s is not null and t is not null").distinct(), "asked")
    found = [asked.where("s = t").select("s", "t", F.lit(0).alias("d"))]
    apart, left = counted(asked.where("s <> t"), "open")
    # both ends search: side 0 from the starts along the edges, side 1 from the targets against them
    edges = (step, step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends, open_, size = ("s", "t"), apart, [left, left]
    met = [[apart.select(F.col(e).alias("s"), F.col(e).alias("v")).distinct()] for e in ends]
    last = [m[0] for m in met]
    for k in range(1, max_hops + 1):
        if not left or not all(size):
            break
        side = int(size[1] < size[0])
        front, old = last[side], reduce(DataFrame.union, met[side]).withColumn("new", F.lit(False))
        if len(found) > 1:  # ends with nothing left to find go no further
            busy = open_.select(F.col(ends[side]).alias("s")).distinct()
            front, old = front.join(busy, "s", "left_semi"), old.join(busy, "s", "left_semi")
        nxt = front.join(edges[side], F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), F.lit(True).alias("new"))
        last[side], size[side] = counted(nxt.union(old).groupBy("s", "v").agg(F.min("new").alias("new")).where("new").drop("new"), "layer")
        met[side].append(last[side])
        # a path of k hops has a vertex on the outermost layer of either side
        a, b = last[0].withColumnRenamed("v", "x"), last[1].select(F.col("s").alias("t"), F.col("v").alias("x"))
        hit, n = counted(open_.join(a, "s").join(b, ["t", "x"]).select("s", "t").distinct(), "hit")
        if n:
            found.append(hit.select("s", "t", F.lit(k).alias("d")))
            left -= n
            open_ = apart.join(reduce(DataFrame.union, found[1:]).select("s", "t"), ["s", "t"], "left_anti")
            if left:
                # an end whose layer is empty by now has no more to find
                sides = [last[i].join(open_.select(F.col(e).alias("s")).distinct(), "s", "left_semi").select(F.lit(i).alias("side")) for i, e in enumerate(ends)]
                n_of = {r[0]: r[1] for r in sides[0].union(sides[1]).groupBy("side").count().collect()}
                size = [n_of.get(0, 0), n_of.get(1, 0)]
    known = reduce(DataFrame.union, found)
    return rows.join(known, ["s", "t"], "left").select(F.col("s").alias(start), F.col("t").alias(target), F.coalesce("d", F.lit(-1)).alias("distance"))
