"""Exact samples by hash order, and proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(key: str, seed: int | str) -> Column:
    """A pseudo-random order that SQL engines share."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer); a sampling operator."""
    return df.orderBy(ticket(key, seed), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum; candidates are cut to n in salted parts before the last rank."""
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    out = df.withColumn("_t", ticket(key, seed)).withColumn("_s", salt)
    for keys in ([stratum, "_s"], [stratum]):
        w = Window.partitionBy(*keys).orderBy("_t", key)
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return out.drop("_t", "_s", "_r")


def disjoint_strata(df: DataFrame, key: str, steps: list[tuple[str, DataFrame, int, int]]) -> DataFrame:
    """Samples drawn one after the other, none from rows drawn before: (name, pool, n, seed)."""
    out = None
    for name, pool, n, seed in steps:
        rest = pool if out is None else pool.join(out.select(key), key, "left_anti")
        part = sample(rest, key, n, seed).withColumn("stratum", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def proportional_allocation(sizes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, size, allocated): shares of n by largest remainder, at most the size."""
    total = sizes.agg(F.sum(size).alias("_total"))
    raw = F.lit(n) * F.col(size) / F.col("_total")
    rows = sizes.crossJoin(total).withColumn("_floor", F.floor(raw)).withColumn("_rest", raw - F.floor(raw))  # one row
    whole, order = Window.partitionBy(F.lit(0)), Window.orderBy(F.desc("_rest"), key)  # over strata
    rows = rows.withColumn("_left", F.lit(n) - F.sum("_floor").over(whole)).withColumn("_place", F.row_number().over(order))
    more = F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    return rows.select(key, size, F.least(F.col("_floor") + more, F.col(size)).cast("long").alias("allocated"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a fixed pseudo-random order."""
    return df.orderBy(ticket(key, seed), key)
