"""Joins, intersections and selections on flat or pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.graph import numbered
from hopweave.storage import counted, stored

#: Columns of a block of ``complement``, and pairs that one of its tasks lists.
BLOCK, TASK_PAIRS = 4096, 1 << 26


def hash_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on one key: a's columns, then b's without the key; a bag."""
    same = (set(a.columns) & set(b.columns)) - {key}
    if same:
        raise ValueError(f"columns on both sides: {sorted(same)}")
    return a.join(b, key).select(*a.columns, *[c for c in b.columns if c != key])


def hash_join_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The join's row count, as a sum of products of group sizes: nothing is joined row by row."""
    na, nb = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    return na.join(nb, key).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("count"))


def semi_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys (1 to 4 columns) occur in b."""
    if not 1 <= len(keys) <= 4:
        raise ValueError("1 to 4 keys")
    return a.join(b.select(*keys), keys, "left_semi").select(*a.columns)


def semi_join_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return count(semi_join(a, b, keys))


def mintersect(base: DataFrame, new: str, edges: list[DataFrame]) -> DataFrame:
    """Bind one more variable: rows of ``base`` (a bag) with every x such that (u_i, x)
    is in each edge table (sets; columns u_i and ``new`` in any order).

    The table that the optimizer takes for the smallest proposes, the others test by
    semi-joins, so no intermediate result exceeds what the first proposes."""
    if not edges:
        raise ValueError("at least one edge table")
    edges = sorted(edges, key=_estimated)
    out = base
    for i, e in enumerate(edges):
        own = [c for c in e.columns if c != new]
        if len(e.columns) != 2 or len(own) != 1 or own[0] not in base.columns:
            raise ValueError(f"an edge table has {new} and one column of the base, not {e.columns}")
        out = out.join(e.distinct(), own[0]) if i == 0 else out.join(e, [own[0], new], "left_semi")
    return out.select(*base.columns, new)


def _estimated(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a table; known sizes for written ones."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def mintersect_count(base: DataFrame, new: str, edges: list[DataFrame]) -> DataFrame:
    return count(mintersect(base, new, edges))


def select_targets(pairs: DataFrame, target: str, ids: DataFrame, id_col: str | None = None) -> DataFrame:
    """Pairs whose target is among the ids."""
    return pairs.join(ids.select(F.col(id_col or target).alias(target)), target, "left_semi").select(*pairs.columns)


def pair_filter(pairs: DataFrame, condition: Column) -> DataFrame:
    return pairs.where(condition)


def transpose(pairs: DataFrame) -> DataFrame:
    """The two first columns swapped, others behind them as they are."""
    a, b, *rest = pairs.columns
    return pairs.select(b, a, *rest)


def boolean_product(left: DataFrame, right: DataFrame, mid: str) -> DataFrame:
    """Distinct (l, r) that share a ``mid``: left (l, mid), right (r, mid)."""
    a, b = [next(c for c in d.columns if c != mid) for d in (left, right)]
    return left.join(right, mid).select(a, b).distinct()


def zip_merge(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal ordinal side by side; tables that do not match row for row raise when run."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ordinal, "full")
    fits = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = both.withColumn(ordinal, F.when(fits, F.col(ordinal)).otherwise(F.raise_error(F.lit("tables of unequal length"))))
    return checked.where(F.col(ordinal).isNotNull()).select(ordinal, *[c for c in [*a.columns, *b.columns] if c != ordinal])


def fetch_property(df: DataFrame, vertices: DataFrame, var: str, prop: str, alias: str | None = None) -> DataFrame:
    """Append a vertex property; null where there is no such vertex."""
    p = vertices.select(F.col("id").alias("_id"), F.col(prop).alias(alias or prop))
    return df.join(p, F.col(var) == F.col("_id"), "left").drop("_id")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def union_pairs(*tables: DataFrame) -> DataFrame:
    """Set union of pair tables."""
    return reduce(DataFrame.union, tables).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a that are not in b."""
    return a.distinct().join(b, a.columns, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def complement(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All (row, column) pairs that are not in ``pairs``; as large as rows times columns.

    Columns lie in blocks of about ``BLOCK``. What is dealt is one line a row and block; the block's
    columns, less those that ``pairs`` has for the row, are listed in the last stage, so that the
    product is never shuffled and a task holds one block."""
    (s,), (t,), spark = rows.columns, columns.columns, rows.sparkSession
    left, n_rows = counted(rows.distinct().toDF("_s"), "rows")
    right, n_columns = counted(columns.distinct().toDF("_t"), "columns")
    n_blocks = max(1, -(-n_columns // BLOCK))
    right = right.select("_t", F.pmod(F.xxhash64("_t"), F.lit(n_blocks)).alias("_block"))
    # lists leave nulls out
    null, right = right.where("_t is null"), right.where("_t is not null")
    blocks = stored(right.groupBy("_block").agg(F.collect_list("_t").alias("_all")), "blocks")
    taken = right.join(pairs.select(F.col(pairs.columns[0]).alias("_s"), F.col(pairs.columns[1]).alias("_t")), "_t")
    taken = left.join(taken, "_s").groupBy("_s", "_block").agg(F.collect_set("_t").alias("_taken"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * n_columns // TASK_PAIRS))
    dealt = left.crossJoin(spark.range(n_blocks).toDF("_block")).repartition(n, "_s", "_block")
    both = dealt.join(taken, ["_s", "_block"], "left").join(blocks, "_block")
    free = F.when(F.col("_taken").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_taken"))
    listed = both.select(F.col("_s").alias(s), F.explode(free).alias(t))
    return listed.union(left.crossJoin(null.select("_t")))


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return not intersection(a, b).isEmpty()


def split_by(df: DataFrame, key: str) -> dict[object, DataFrame]:
    """Sub-tables without the key column, by key value. One small job lists the keys;
    for many keys group by the column instead."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).toLocalIterator()]
    return {k: df.where(F.col(key).eqNullSafe(F.lit(k))).drop(key) for k in keys}


def reorder(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The k first rows; each task keeps k at most."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank`` int from 1 in the given order, sorted by it. Rows are numbered by ranges; no task sees them all."""
    rows = numbered(df, *order)
    # one row a part, so a window over all of them is small
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = (F.col("base") + F.col("at")).cast("int").alias("rank")
    return reorder(rows.join(F.broadcast(base), "part").select(*df.columns, rank), "rank")
