"""Diversity, concentration and divergence metrics on count frames.

A count frame has a row for each category with its count; it is the one shuffle of a
metric. Everything after it works on categories, never on rows of the fact table, so the
ordered windows of Gini and Lorenz see as many rows as there are categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.ranks import quantiles, running

FLOOR = 1e-12


def counts(df: DataFrame, *keys: str, fill: str | None = None, drop_null: bool = True) -> DataFrame:
    """Count frame (keys, n). Null keys are dropped, or labelled with ``fill``."""
    cols = [F.coalesce(F.col(k).cast("string"), F.lit(fill)).alias(k) if fill is not None else F.col(k) for k in keys]
    df = df.select(*cols)
    if drop_null and fill is None:
        df = df.na.drop(subset=list(keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def fractions(frame: DataFrame, n: str = "n") -> DataFrame:
    """Add ``fraction`` of the total."""
    total = frame.agg(F.sum(n).alias("_total"))
    return frame.crossJoin(F.broadcast(total)).withColumn("fraction", F.col(n) / F.col("_total")).drop("_total")  # one row


def entropy_of(p_log_p: Column, total: Column) -> Column:
    """Bits, from sum(n * log2 n) and sum(n)."""
    return F.when(total > 0, F.log2(total) - p_log_p / total).otherwise(F.lit(0.0))


def summary(frame: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """One row (a row of each ``by``): categories, total, entropy, normalised entropy, Gini, Simpson.

    Equal counts are one row with their multiplicity before they are ranked, so the window
    runs over different counts, however many categories have them.
    """
    same = frame.where(F.col(n) >= 0).groupBy(*by, F.col(n).alias("_n")).agg(F.count("*").alias("_m"))
    below = F.coalesce(F.sum("_m").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    positive = F.col("_n") > 0
    out = same.withColumn("_below", below.cast("double")).groupBy(*by).agg(
        F.sum(F.when(positive, F.col("_m")).otherwise(0)).cast("long").alias("categories"),
        F.sum("_m").alias("_k"),
        F.sum(F.col("_n") * F.col("_m")).cast("long").alias("total"),
        F.sum(F.when(positive, m * c * F.log2(c)).otherwise(0.0)).alias("_plogp"),
        F.sum(m * c * c).alias("_squares"),
        F.sum(c * (m * F.col("_below") + m * (m + 1) / 2)).alias("_ranked"),
    )
    total, k = F.col("total").cast("double"), F.col("_k").cast("double")
    h = entropy_of(F.col("_plogp"), total)
    return out.select(
        *by,
        "categories",
        "total",
        h.alias("entropy_bits"),
        F.when(F.col("categories") > 1, h / F.log2("categories")).otherwise(0.0).alias("normalized_entropy"),
        F.when(total > 0, (2 * F.col("_ranked") - (k + 1) * total) / (k * total)).otherwise(0.0).alias("gini"),
        F.when(total > 0, 1 - F.col("_squares") / (total * total)).otherwise(0.0).alias("simpson"),
    )


def align(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Two count frames on their common support: key, a, b; 0 where absent."""
    left, right = a.select(key, F.col(n).alias("a")), b.select(key, F.col(n).alias("b"))
    both = left.join(right, key, "full")
    return both.select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def normalised(aligned: DataFrame) -> DataFrame:
    """Add the shares ``p`` and ``q``."""
    totals = aligned.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    share = lambda c, t: F.col(c) / F.greatest(F.col(t).cast("double"), F.lit(FLOOR))
    return aligned.crossJoin(F.broadcast(totals)).withColumn("p", share("a", "_a")).withColumn("q", share("b", "_b")).drop("_a", "_b")  # one row


def jensen_shannon(aligned: DataFrame) -> DataFrame:
    """One row ``jsd`` in bits, in [0, 1]."""
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.greatest(m, F.lit(FLOOR)))).otherwise(0.0))
    return normalised(aligned).agg((kl("p") / 2 + kl("q") / 2).alias("jsd"))


def residuals(aligned: DataFrame, key: str) -> DataFrame:
    """key, p, q, residual p - q."""
    return normalised(aligned).select(key, "p", "q", (F.col("p") - F.col("q")).alias("residual"))


def top(frame: DataFrame, k: int, *keys: str, n: str = "n") -> DataFrame:
    """The k largest categories, ties by key."""
    return frame.orderBy(F.desc(n), *keys).limit(k)


def top_share(frame: DataFrame, k: int, *keys: str, n: str = "n") -> DataFrame:
    """One row: share of the k largest categories."""
    best = top(frame, k, *keys, n=n).agg(F.sum(n).alias("top"))
    return frame.agg(F.sum(n).alias("total")).crossJoin(best).select(F.lit(k).alias("k"), (F.col("top") / F.col("total")).alias("share"))


def lorenz(frame: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """Points of the Lorenz curve: rank, share of categories, share of the total.

    Categories may be as many as rows, so they are ranked in ranges.
    """
    whole = frame.agg(F.count("*").alias("_categories"), F.sum(n).alias("_total"))
    points = running(frame.select(*keys, n), [n, *keys], _upto=n).crossJoin(whole)  # one row
    return points.select(*keys, n, "rank", (F.col("rank") / F.col("_categories")).alias("category_share"), (F.col("_upto") / F.col("_total")).alias("total_share"))


def trapezoid_gini(points: DataFrame) -> DataFrame:
    """Gini again, from the area under Lorenz points; each meets the one of the rank before."""
    before = points.select((F.col("rank") + 1).alias("rank"), F.col("category_share").alias("_x"), F.col("total_share").alias("_y"))
    x, y = F.coalesce("_x", F.lit(0.0)), F.coalesce("_y", F.lit(0.0))
    area = (F.col("category_share") - x) * (F.col("total_share") + y) / 2
    return points.join(before, "rank", "left").agg((1 - 2 * F.sum(area)).alias("gini"))


def describe(df: DataFrame, col: str, *by: str, below: tuple[float, ...] = (), ranked: bool = True) -> DataFrame:
    """count, mean, median, both standard deviations, p95, p99, min, max, shares below cuts.

    Quantiles write the values and take several passes over them; without ``ranked`` there are none, and one pass.
    """
    c = F.col(col).cast("double")
    more = [F.avg((c < t).cast("int")).alias(f"below_{t:g}".replace(".", "_")) for t in below]
    moments = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std_sample"), F.stddev_pop(c).alias("std_population"), F.min(c).alias("min"), F.max(c).alias("max"), *more)
    if not ranked:
        return moments
    places = quantiles(df, col, [0.5, 0.95, 0.99], *by).select(*[F.col(b).alias(f"_{b}") for b in by], "q")
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
    at = {name: F.col("q")[i].alias(name) for i, name in enumerate(("median", "p95", "p99"))}
    return moments.join(places, same, "left").select(*by, "n", "mean", at["median"], "std_sample", "std_population", at["p95"], at["p99"], "min", "max", *[c for c in moments.columns if c.startswith("below_") and c not in by])


def weighted_mean(frame: DataFrame, value: str, n: str = "n") -> DataFrame:
    return frame.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("weighted_mean"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Contingency table with the given columns, absent cells 0."""
    cells = [F.count(F.when(F.col(col) == v, 1)).alias(str(v)) for v in values]
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(*cells)


def shared_flag(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``shared``: whether the key occurs more than once.

    The counts are aggregated before the join, so a frequent key is one row on that side.
    """
    many = df.groupBy(*keys).agg((F.count("*") > 1).alias("shared"))
    return df.join(many, list(keys), "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def one_to_many(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many values of a map to several of b, the most, and the other way round."""
    pairs = df.select(a, b).na.drop().distinct()
    parts = []
    for x in (a, b):
        per = pairs.groupBy(x).agg(F.count("*").alias("n"))
        parts.append(per.agg(F.count("*").alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("with_many"), F.max("n").alias("most")).withColumn("key", F.lit(x)))
    return parts[0].unionByName(parts[1])


def species_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with both values, and shares that are equal, raw and trimmed and lowered."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.trim(a) != "") & (F.trim(b) != ""))
    norm = lambda c: F.lower(F.trim(c))
    return both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("raw_rate"), F.avg((norm(a) == norm(b)).cast("int")).alias("normalized_rate"))


def mismatches(df: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """The most frequent unequal pairs, as ``a / b``."""
    odd = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.lower(F.trim(a)) != F.lower(F.trim(b))))
    return top(odd.groupBy(F.concat_ws(" / ", a, b).alias("pair")).agg(F.count("*").alias("n")), k, "pair")
