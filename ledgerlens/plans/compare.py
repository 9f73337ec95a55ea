"""Snapshots of diversity, before/after comparison, population cuts and representative sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators.joins import keep_one
from ledgerlens.sources.stage import checkpointed

#: seeds whose least tickets are the state of one aggregate
SEEDS_AT_ONCE = 100


def snapshot(df: DataFrame, categories: dict[str, Column], flags: dict[str, Column] | None = None, means: dict[str, Column] | None = None, *by: str) -> DataFrame:
    """Long rows (by, metric, value): rows, and for each category entropy, Gini and variety.

    All histograms come from one aggregate over the rows: each row is unpivoted to
    (dimension, category), so one shuffle of counts serves every category. Null categories
    are left out; callers label them where they count.
    """
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("cat")) for n, c in categories.items()])
    n = df.select(*by, F.explode(dims).alias("d")).select(*by, "d.dim", "d.cat").where("cat IS NOT NULL").groupBy(*by, "dim", "cat").agg(F.count("*").alias("n"))
    each = M.summary(n, *by, "dim")
    measure = F.array(*[F.struct(F.concat("dim", F.lit(suffix)).alias("metric"), F.col(c).cast("double").alias("value")) for suffix, c in (("_entropy_bits", "entropy_bits"), ("_normalized_entropy", "normalized_entropy"), ("_gini", "gini"), ("_n_unique", "categories"))])
    out = each.select(*by, F.explode(measure).alias("m")).select(*by, "m.*")
    totals = [F.count("*").cast("double").alias("n_rows")]
    totals += [F.avg(c.cast("int")).alias(k) for k, c in (flags or {}).items()]
    totals += [F.avg(c.cast("double")).alias(k) for k, c in (means or {}).items()]
    names = ["n_rows", *(flags or {}), *(means or {})]
    whole = df.groupBy(*by).agg(*totals)
    wide = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])
    return out.unionByName(whole.select(*by, F.explode(wide).alias("m")).select(*by, "m.*"))


def delta(before: DataFrame, after: DataFrame, digits: int = 6) -> DataFrame:
    """metric, before, after, absolute and relative change; null where before is 0."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full")
    change = F.col("after") - F.col("before")
    relative = F.try_divide(change, F.nullif(F.col("before"), F.lit(0.0)))
    return both.select("metric", F.round("before", digits).alias("before"), F.round("after", digits).alias("after"), F.round(change, digits).alias("absolute_delta"), F.round(relative, digits).alias("relative_delta"))


def before_after(df: DataFrame, cluster: str, order: list, categories: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """The snapshot of all rows against that of one representative a cluster."""
    return delta(snapshot(df, categories, flags), snapshot(keep_one(df, [cluster], *order), categories, flags))


def population_cuts(df: DataFrame, cuts: dict[str, Column], categories: dict[str, Column]) -> DataFrame:
    """Snapshots of several overlapping populations in one pass: (population, metric, value)."""
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cuts.items()]), lambda x: x.isNotNull())
    return snapshot(df.withColumn("population", F.explode(names)), categories, None, None, "population")


def focused_snapshot(df: DataFrame, cluster: str, cls: str, target: str, k: int = 10) -> DataFrame:
    """(metric, value) of bound rows: clusters with their top-k share, classes, and the share of one class.

    Null clusters and classes are left out of their own metrics.
    """
    found = snapshot(df, {"cluster": F.col(cluster), "class": F.col(cls)}, None, {f"{target}_fraction": F.when(F.col(cls).isNotNull(), (F.col(cls) == target).cast("double"))})
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    share = M.top_share(sizes, k, cluster).select(F.lit(f"cluster_top{k}_share").alias("metric"), F.col("share").alias("value"))
    return found.unionByName(share)


def draw_spread(rows: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(metric, seeds, low, high, mean, std) of the snapshots by ``seed``."""
    v = F.col("value")
    return snapshot(rows, categories, None, None, "seed").groupBy("metric").agg(F.count("*").alias("seeds"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def representative_sweep(df: DataFrame, cluster: str, key: str, category: str, seeds: int) -> DataFrame:
    """One row: spread of a category's entropy over random choices of representatives."""
    chosen = random_representatives(df, cluster, key, seeds, category)
    each = draw_spread(chosen, {"c": F.col(category)})
    return each.where("metric = 'c_entropy_bits'").drop("metric")


def metric_sweep(df: DataFrame, cluster: str, key: str, categories: list[str], seeds: int = 200) -> DataFrame:
    """(metric, seeds, low, high, mean, std) of every metric over random choices of representatives."""
    chosen = random_representatives(df, cluster, key, seeds, *categories)
    return draw_spread(chosen, {c: F.col(c) for c in categories})


def random_representatives(df: DataFrame, cluster: str, key: str, seeds: int, *carry: str) -> DataFrame:
    """(seed, cluster, key, carry): one row for each cluster and seed, that of the least hash of seed and key.

    A row is read once for all seeds: the state of a cluster is one least ticket for each of
    ``SEEDS_AT_ONCE`` seeds, so what is shuffled follows the clusters, not rows times seeds. A
    cluster of one row is its own choice and takes no part in that. Of rows with one key, the
    least carried values count; a null cluster is a cluster.
    """
    rows = df.select(F.col(cluster).alias("_c"), F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(carry)]).alias("row"))
    per = checkpointed(rows.groupBy("_c").agg(F.count("*").alias("n"), F.min("row").alias("row")))
    found = [per.where("n = 1").select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), "_c", "row")]
    many = rows.join(per.where("n > 1").select(F.col("_c").alias("_many")), F.col("_c").eqNullSafe(F.col("_many")), "left_semi")
    for low in range(0, seeds, SEEDS_AT_ONCE):
        at = range(low, min(low + SEEDS_AT_ONCE, seeds))
        ticket = lambda s: F.unhex(F.md5(F.concat_ws(":", F.lit(str(s)), F.col("row.k"))))
        least = many.groupBy("_c").agg(*[F.min(F.struct(ticket(s).alias("t"), "row")).alias(f"s{s}") for s in at])
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"s{s}.row").alias("row")) for s in at])).alias("x")
        found.append(least.select("_c", each).select("x.seed", "_c", "x.row"))
    return reduce(DataFrame.unionByName, found).select("seed", F.col("_c").alias(cluster), F.col("row.k").alias(key), *[F.col(f"row.v{i}").alias(c) for i, c in enumerate(carry)])


def accounting(df: DataFrame, **levels: list[str]) -> DataFrame:
    """(level, n): rows, and distinct combinations at each granularity."""
    rows = [df.agg(F.count("*").alias("n")).withColumn("level", F.lit("rows"))]
    rows += [df.select(*keys).distinct().agg(F.count("*").alias("n")).withColumn("level", F.lit(name)) for name, keys in levels.items()]
    return reduce(DataFrame.unionByName, rows).select("level", "n")


def with_shares(df: DataFrame, n: str, *by: str) -> DataFrame:
    return df.withColumn("percent", 100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(*(by or [F.lit(0)]))))
