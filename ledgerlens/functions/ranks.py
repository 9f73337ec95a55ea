"""Ranks, running sums and exact quantiles that no single task holds.

``running`` deals rows in ranges of a total order, scans each range and shifts it by the sums
of the ranges before. ``quantiles`` narrows the range around each wanted rank in a few passes
of counts; a pass sends at most ``BINS`` counts of each range that is still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.stage import checkpointed

#: parts of a range in a pass, and rows of a range that are counted by value instead
BINS, SMALL = 1024, 4096
#: the largest finite double; NaN and infinity stand beyond it
MOST = 1.7976931348623157e308


def running(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Add ``rank`` (from 1) in a total order and, for name=column, running sums to each row.

    The window over ranges has a row for each task's range, never one for each row.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per = dealt.groupBy("_range").agg(F.count("*").alias("_rank"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in ("rank", *sums)])
    here = dealt.select("*", F.count(F.lit(1)).over(own).alias("rank"), *[F.sum(c).over(own).alias(n) for n, c in sums.items()])
    out = here.join(shift, "_range")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in ("rank", *sums)])


def quantiles(df: DataFrame, col: str, probabilities: list[float], *by: str, rounds: int = 200) -> DataFrame:
    """(by, n, q): exact quantiles with linear interpolation, in the order of ``probabilities``.

    Nulls are left out, NaN is the largest value, a group of nulls has no row; without ``by``
    there is one row, of nulls where there is no value. Ranks are found
    by counting a group's values in ``BINS`` parts of a range, even and near its lower end in
    turn, then within the part that holds the rank; a part of few rows, or of one place, is
    counted by value. Fails if ``rounds`` are not enough.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = checkpointed(df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(col).cast("double").alias("v")).where("v IS NOT NULL"))
    place = F.when(F.isnan("v"), F.lit(MOST)).otherwise(F.greatest(F.least("v", F.lit(MOST)), F.lit(-MOST))) / 2  # halves: their differences are finite
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    at = [F.col("n") - 1, *[F.lit(p) * (F.col("n") - 1) for p in probabilities]][1:]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    part = F.struct("low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows"), ranks.alias("ranks"))
    state = checkpointed(groups.select(*keys, "n", F.array(part).alias("parts")))
    still = lambda p: (p["rows"] > SMALL) & (p["low"] < p["high"])

    def met(parts: Column) -> DataFrame:
        """Rows with the part that they are in; parts do not overlap."""
        wanted = null_safe(rows, state.select(*keys, parts.alias("parts")).where(F.size("parts") > 0), keys)
        wanted = wanted.withColumn("u", place).select(*keys, "v", "u", F.explode(F.filter("parts", lambda p: F.col("u").between(p["low"], p["high"]))).alias("p"))
        return wanted.select(*keys, "v", "u", "p.*")

    for i in range(rounds):
        if state.where(F.exists("parts", still)).isEmpty():
            break
        share = (F.col("u") - F.col("low")) / (F.col("high") - F.col("low"))
        if i % 2:
            share = F.log1p(share * 2.0**400) / F.log1p(F.lit(2.0**400))
        number = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        counts = met(F.filter("parts", still)).groupBy(*keys, "low", number.alias("bin")).agg(F.count("*").alias("rows"), F.min("u").alias("least"), F.max("u").alias("most"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
        # at most BINS rows of a part
        up_to = F.col("before") + F.sum("rows").over(Window.partitionBy(*keys, "low").orderBy("bin"))
        inside = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("rows")) & (r < F.col("upto")))
        found = counts.withColumn("upto", up_to).withColumn("ranks", inside).where(F.size("ranks") > 0)
        finer = found.select(*keys, F.struct(F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("rows")).alias("before"), "rows", "ranks").alias("p"))
        # parts of a group are no more than its ranks
        finer = finer.groupBy(*keys).agg(F.collect_list("p").alias("more"))
        both = F.concat(F.filter("parts", lambda p: ~still(p)), F.coalesce("more", F.array().cast(state.schema["parts"].dataType)))
        state = checkpointed(null_safe(state, finer, keys, "left").select(*keys, "n", both.alias("parts")))
    else:
        raise RuntimeError(f"quantiles have not settled in {rounds} rounds")
    values = met(F.col("parts")).groupBy(*keys, "low", "v").agg(F.count("*").alias("rows"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    # at most SMALL different values of a part, or those that share a place
    up_to = F.col("before") + F.sum("rows").over(Window.partitionBy(*keys, "low").orderBy("v"))
    hit = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("rows")) & (r < F.col("upto")))
    one = values.withColumn("upto", up_to).select(*keys, "v", F.explode(hit).alias("r"))
    one = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    out = null_safe(state.select(*keys, "n"), one, keys)

    def value(x: Column) -> Column:
        below, above = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.element_at("at", below), F.element_at("at", above)
        return F.when((below == above) | (a == b), a).otherwise((above - x) * a + (x - below) * b)

    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n", F.array(*[value(x) for x in at]).alias("q"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal; without keys, of one row on the right."""
    if not keys:
        return left.join(right, F.lit(True), how)
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])
