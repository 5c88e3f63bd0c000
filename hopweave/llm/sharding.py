"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size; the shards take turns claiming their next free slot until the table is
full.  Placing a row is then one hash and one lookup in a broadcast table whose
size is a parameter, so no row is shuffled, however skewed the keys are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import free_name

#: A fixed bound: the broadcast table has this many rows at most.
MAX_SLOTS = 1 << 20


def _number(text: str) -> int:
    """The first 60 bits of the MD5 digest, as SQL engines can compute it too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: int, n_slots: int) -> tuple[int, int]:
    """(offset, skip) of a shard's preference order."""
    return _number(f"offset-{shard}") % n_slots, _number(f"skip-{shard}") % (n_slots - 1) + 1


def fill(n_shards: int, n_slots: int) -> list[int]:
    """The shard of each slot. Control data of a fixed size, made on the driver."""
    if n_slots > MAX_SLOTS or n_shards > n_slots or n_shards < 1 or any(n_slots % d == 0 for d in range(2, int(n_slots**0.5) + 1)):
        raise ValueError(f"n_slots must be a prime of at most {MAX_SLOTS} and not under n_shards >= 1")
    orders = [preference(s, n_slots) for s in range(n_shards)]
    step, owner, left = [0] * n_shards, [-1] * n_slots, n_slots
    while left:
        for s, (offset, skip) in enumerate(orders):
            while owner[(offset + step[s] * skip) % n_slots] >= 0:
                step[s] += 1
            owner[(offset + step[s] * skip) % n_slots] = s
            left -= 1
            if not left:
                break
    return owner


def slot_table(spark: SparkSession, n_shards: int, n_slots: int) -> DataFrame:
    """(slot int, shard int), unpacked from one literal of four bytes a slot."""
    packed = b"".join(s.to_bytes(4, "big") for s in fill(n_shards, n_slots))
    at = (F.col("id") * 4 + 1).cast("int")
    owner = F.conv(F.hex(F.substring(F.lit(packed), at, F.lit(4))), 16, 10).cast("int")
    return spark.range(0, n_slots, 1, 1).select(F.col("id").cast("int").alias("slot"), owner.alias("shard"))


def slot_of(key: Column, n_slots: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def place(df: DataFrame, key: str, n_shards: int = 32, n_slots: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` behind its columns.

    A null key counts as the empty string; equal keys always share a shard;
    row order and repeated rows are kept as they are; an empty table gives an
    empty result. Columns of ``df`` already called ``slot`` or ``shard`` (in any
    letter case) are replaced; if the key is called so, it stays as ``<name>_key``.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("slot", "shard") and c != key])
    if key.lower() in ("slot", "shard"):
        name = free_name(df.columns, f"{key}_key")
        df, key = df.withColumnRenamed(key, name), name
    keyed = df.withColumn("slot", slot_of(F.col(f"`{key}`"), n_slots))
    return keyed.join(F.broadcast(slot_table(df.sparkSession, n_shards, n_slots)), "slot").select(*[keyed[f"`{c}`"] for c in df.columns], "slot", "shard")
