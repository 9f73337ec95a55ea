"""Joins with priority, fallback, null-safe keys, containment and pairs.

Small sides are left to the planner's own size-checked broadcast; no hint forces one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def keep_one(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order.

    Each task keeps one row of a key before rows are shuffled, so a hot key sends as many rows
    as there are tasks.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def priority_join(left: DataFrame, right: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Left join to the best right row of each key."""
    return left.join(keep_one(right, keys, *order), keys, "left")


def fallback_join(left: DataFrame, right: DataFrame, exact: list[str], loose: str, distinct: list[str], pick: list[str], value: str) -> DataFrame:
    """Add ``value`` and ``match``: exact, fallback or none.

    A row without an exact match takes the least row of its ``loose`` key where that key has
    exactly one different combination of ``distinct``.
    """
    exact_rows = keep_one(right, exact, *[F.desc(c) for c in pick]).select(*exact, F.col(value).alias("_exact"), F.lit(1).alias("_hit"))
    only = right.groupBy(loose).agg(F.count_distinct(F.struct(*distinct)).alias("_kinds"), F.min_by(value, F.struct(*pick)).alias("_loose")).where("_kinds = 1").select(loose, "_loose", F.lit(1).alias("_fallback"))
    both = left.join(exact_rows, exact, "left").join(only, loose, "left")
    return both.withColumn(value, F.when(F.col("_hit") == 1, F.col("_exact")).otherwise(F.col("_loose"))).withColumn(
        "match", F.when(F.col("_hit") == 1, "exact").when(F.col("_fallback") == 1, "fallback").otherwise("none")
    ).drop("_exact", "_hit", "_loose", "_fallback")


def checked_inner_join(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and a one-row frame of how many left rows were lost."""
    return left.join(right, keys), left.join(right, keys, "left_anti").agg(F.count("*").alias("lost"))


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises where the right key repeats, so rows are never multiplied."""
    many = right.groupBy(*keys).count().where("count > 1").limit(1).count()
    if many:
        raise ValueError(f"the join would multiply rows: {keys} repeat on the right")
    old = [c for c in right.columns if c in left.columns and c not in keys]  # stale columns
    return left.drop(*old).join(right, keys, "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Left join in which nulls are equal, to the first right row; adds ``fan_out``."""
    first = keep_one(right, keys, *order)
    many = right.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("fan_out"))
    side = first.join(many, _same(keys)).drop(*[f"_{k}" for k in keys])
    side = side.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in side.columns])
    return left.join(side, _same(keys), "left").drop(*[f"_{k}" for k in keys])


def _same(keys: list[str]) -> Column:
    """Keys equal to those of a leading underscore, nulls too."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def sentinel_key(*cols: str) -> Column:
    """A composite key in which nulls are equal."""
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cols])


def containment_join(left: DataFrame, right: DataFrame, keys: list[str], item: str, items: str, *order: Column | str) -> DataFrame:
    """Left rows with the last right row (in the given order) whose array holds ``item``.

    The array is exploded, so containment is an equality and never a loop over pairs.
    """
    flat = right.withColumn(item, F.explode(F.array_distinct(items)))
    return left.join(keep_one(flat, [*keys, item], *order), [*keys, item])


def _in_blocks(df: DataFrame, cluster: list[str], key: str, value: str, tile: int) -> DataFrame:
    """(cluster, _k, _v, _rows, _blocks, _own): rows with the number of their cluster's blocks, and their own block."""
    large = df.groupBy(*cluster).agg(F.count("*").alias("_rows")).where(F.col("_rows") > tile)
    rows = df.select(*cluster, F.col(key).alias("_k"), F.col(value).alias("_v")).join(large, cluster, "left")
    rows = rows.withColumn("_blocks", F.ceil(F.coalesce("_rows", F.lit(1)) / tile).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int"))
    return rows


def tiled(df: DataFrame, cluster: list[str], key: str, value: str, tile: int = 1024) -> DataFrame:
    """(cluster, _i, _j, _own, _k, _v): the rows of each tile (_i, _j) of a cluster together, in order of tiles.

    Blocks are cut as in ``pairs_within``, and a tile is of a block with itself or a later one; a
    row is sent once for each of its tiles, and a kernel makes the pairs where they meet.
    """
    rows = _in_blocks(df, cluster, key, value, tile)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = rows.select(*cluster, "_own", "_k", "_v", other).select(*cluster, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_k", "_v")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *cluster, "_i", "_j").sortWithinPartitions(*cluster, "_i", "_j")


#: keys of a list that a row meets at once, so that many pairs are made before they are handed on
CHUNK = 256


def pairs_within(df: DataFrame, cluster: list[str], key: str, value: str, tile: int = 16384) -> DataFrame:
    """Pairs (cluster, a, value_a, b, value_b), a < b, of rows of a cluster; null clusters have none.

    A cluster of more than ``tile`` rows is cut by a hash of the key in as many blocks as its
    own size asks for. A block is dealt as two sorted lists, of keys and of values (of a type that
    can be sorted), to as many tiles as there are blocks, once for either side of a pair. In a
    tile, keys of one block meet the later keys of another, in chunks. Shuffles hold lists of
    rows in blocks, and pairs are made where they are read.
    """
    rows = _in_blocks(df.where(F.col(key).isNotNull()), cluster, key, value, tile).dropna(subset=cluster)
    lists = rows.groupBy(*cluster, "_blocks", "_own").agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_list"))
    lists = lists.select(*cluster, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"), "_own", F.col("_list._k").alias("_ks"), F.col("_list._v").alias("_vs"))
    # as many tasks as shuffles have: lists are few beside their pairs, so sizes alone would merge the tiles
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = lambda i, j: lists.select(*cluster, F.col(i).alias("_i"), F.col(j).alias("_j"), "_ks", "_vs").repartition(tasks, *cluster, "_i", "_j")
    a = tiles("_own", "_other").select(*cluster, "_i", "_j", "_vs", F.posexplode("_ks").alias("_at", "_ka")).select(*cluster, "_i", "_j", "_ka", F.get("_vs", "_at").alias("_va"))
    b = tiles("_other", "_own").withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("_ks"), F.lit(CHUNK))))
    b = b.select(*cluster, "_i", "_j", *[F.slice(c, F.col("_from"), F.lit(CHUNK)).alias(c) for c in ("_ks", "_vs")]).withColumn("_last", F.element_at("_ks", -1))
    met = a.join(b, [*cluster, "_i", "_j"]).where("_ka < _last").select(*cluster, "_ka", "_va", "_vs", F.posexplode("_ks").alias("_at", "_kb")).where("_ka < _kb")
    return met.select(*cluster, F.col("_ka").alias("a"), F.col("_va").alias("value_a"), F.col("_kb").alias("b"), F.get("_vs", "_at").alias("value_b"))


def pair_counts(df: DataFrame, cluster: str, size: str) -> DataFrame:
    """Pairs of equal and of unequal size in each cluster, counted without making pairs."""
    per = df.groupBy(cluster, size).agg(F.count("*").alias("_n"))
    two = lambda c: c * (c - 1) / 2
    return per.groupBy(cluster).agg(F.sum(two(F.col("_n"))).cast("long").alias("equal_pairs"), two(F.sum("_n")).cast("long").alias("all_pairs")).withColumn("unequal_pairs", F.col("all_pairs") - F.col("equal_pairs"))


def overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values of a column on both sides."""
    return a.select(col).na.drop().distinct().join(b.select(col).na.drop().distinct(), col)


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are expected and not found."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def require_none(rows: DataFrame, what: str) -> None:
    """Raise where a frame of violations has a row."""
    if found := rows.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
