"""Shared helpers: intermediate tables, table access, byte-level text kernels."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that one task of a shuffle of known size takes.
TASK_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is this machine (tests) is a
    temporary folder made, and removed when the interpreter ends.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hopweave-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set(CHECKPOINT_KEY, root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: cuts
    lineage, survives lost executors and is computed once. The job's shuffle files
    go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, n_bytes: int) -> int:
    """Tasks for a shuffle of so many bytes: the session's number while parts of that
    number are not small, more where they would be large."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(n_bytes / TASK_BYTES), min(n, math.ceil(n_bytes / (TASK_BYTES >> 4))))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, longer where a column is called so already (in any letter case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """A written table of the distinct texts: (uid, key, text, copies). Null counts
    as the empty text; ``key`` is ``text_key``; ``uid`` is stable once written.
    However many copies a text has, each map task sends one."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    one = texts.groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return written(one.select(F.monotonically_increasing_id().alias("uid"), "key", "text", "copies"), "texts")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component) for
    every node but the components' smallest, which is the component.

    Alternating large-star and small-star rounds. Minima are combined map-side
    and no adjacency list is collected, so a node may have any degree.
    """
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    star = written(star, "edges")
    mark = _signature(star)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = star.union(star.select(F.col("v"), F.col("u")))
        # minima are written first, so that Spark may split the rows of a node of any degree in the join
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "lows")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        forget(star, low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        star = written(small.distinct(), "edges")
        forget(large, low)
        old_mark, mark = mark, _signature(star)
        if mark == old_mark:
            break
    else:
        raise RuntimeError("components did not converge")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _signature(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


# ---------------------------------------------------------------- byte kernels

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
P1 = np.uint64(0x9E3779B97F4A7C15)
P1_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = P1, name: str = "p") -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POW[name] = have
    return have[:n]


BYTE_MIX = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """S with S[i] = sum of g(codes[j]) * P^j for j < i, modulo 2^64. Seeds give independent hashes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        if codes.dtype == np.uint8:
            g = (mix(BYTE_MIX + np.uint64(seed)) if seed else BYTE_MIX)[codes]
        else:
            g = mix(codes.astype(np.uint64) + np.uint64(1 + seed))
        g *= powers(len(codes))
        np.cumsum(g, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], independent of the place."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix), P1_INV, "inv")[start])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no ASCII space."""
    gap = np.concatenate(([True], SPACE[data], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts with ``gap`` behind each, and where each starts."""
    lens = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join([t + gap for t in texts]), np.uint8), np.concatenate(([0], np.cumsum(lens)))


def slices(rows: pa.LargeBinaryArray, at: np.ndarray | None = None) -> list[bytes]:
    """The rows' bytes, or those from row at[i] up to row at[i + 1]."""
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    raw = rows.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in pairwise((ends if at is None else ends[at]).tolist())]


def distinct_chunks(data: np.ndarray, cut: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct among data[cut[i]:cut[i + 1]], and the number of each among them."""
    found = binaries(data, cut).dictionary_encode()
    return slices(found.dictionary), found.indices.to_numpy()


def binaries(data: np.ndarray, cut: np.ndarray) -> pa.LargeBinaryArray:
    """data[cut[i]:cut[i + 1]] as an Arrow array over the same memory; ``cut`` counts bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and where each ends, from 0 on."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def chunks(sizes: list[int], limit: int):
    """Index ranges whose sizes sum to about ``limit``; a larger item stands alone."""
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
