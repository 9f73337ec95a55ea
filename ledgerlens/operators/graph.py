"""Components over shared values, budgeted partitions, and leakage between splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans import compare
from ledgerlens.sources.stage import checkpointed

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
#: a value of more than one in so many edges is joined apart
HOT = 1000


def relation_edges(df: DataFrame, key: str, relations: list[str]) -> DataFrame:
    """(key, value vertex) of every non-null relation value."""
    parts = [df.select(F.col(key).alias("k"), F.concat(F.lit(f"{r}="), F.col(r).cast("string")).alias("v")).where("v IS NOT NULL") for r in relations]
    return reduce(DataFrame.unionByName, parts).distinct()


def components(df: DataFrame, key: str, relations: list[str], rounds: int = 200) -> DataFrame:
    """Add ``component``: the least key among rows linked by equal values in any relation.

    Rows meet through value vertices, so a value of many rows makes as many edges, not
    pairs. Each round takes the least label through values, then jumps to the label's own
    label, so chains shorten geometrically; it ends when nothing changes, and fails if
    ``rounds`` are not enough.

    Frames that grow with rows are joined by sorting: the planner takes them for as small as
    their compressed files and would send them through the driver. Only values of more than
    one in ``HOT`` edges, which are fewer than ``HOT``, are broadcast, so none is one task's.
    """
    edges = checkpointed(relation_edges(df, key, relations))
    shared = checkpointed(edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") * HOT > edges.count()))
    often = shared.where("hot").select("v", "hot")
    marked = edges.join(F.broadcast(often), "v", "left")
    rest = marked.where("hot IS NULL").drop("hot").join(shared.where("NOT hot").select("v", "hot").hint("merge"), "v")
    edges = checkpointed(marked.where("hot").unionByName(rest))
    labels = checkpointed(edges.select("k").distinct().select("k", F.col("k").alias("c")))
    for _ in range(rounds):
        by_value = edges.join(labels.hint("merge"), "k").groupBy("v", "hot").agg(F.min("c").alias("c"))
        met = edges.where("hot").join(F.broadcast(by_value.where("hot").drop("hot")), "v").unionByName(edges.where("NOT hot").join(by_value.where("NOT hot").drop("hot").hint("merge"), "v"))
        least = met.groupBy("k").agg(F.min("c").alias("m"))
        jump = labels.select(F.col("k").alias("m"), F.col("c").alias("up"))
        moved = least.join(jump.hint("merge"), "m", "left").select("k", F.least("m", F.coalesce("up", "m")).alias("m"))
        after = checkpointed(labels.join(moved.hint("merge"), "k").select("k", F.least("c", "m").alias("c"), (F.least("c", "m") < F.col("c")).alias("new")))
        labels = after.select("k", "c")
        if not after.where("new").limit(1).count():
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    found = labels.select(F.col("k").alias(key), F.col("c").alias("component"))
    return df.join(found.hint("merge"), key, "left").withColumn("component", F.coalesce("component", key))


def greedy_runs(sizes: list[tuple[int, int]], splits: tuple[tuple[str, float], ...] = SPLITS) -> list[tuple[int, int, int, list[str]]]:
    """(size, first place, last place, splits in turn) of the greedy rule over (size, number) pairs.

    Places count from 0 within a size. While one split has most room, it takes as many as
    keep it first; once all rooms are within a size of each other, the splits take turns in
    one order for good, so a size needs a few runs however many components have it.
    """
    names = [s for s, _ in splits]
    total = sum(n * many for n, many in sizes)
    room, rows = {s: share * total for s, share in splits}, []
    for size, many in sorted(sizes, reverse=True):
        place = 0
        while place < many:
            order = sorted(names, key=lambda s: (-room[s], names.index(s)))
            rounds = (many - place) // len(names)
            if rounds and room[order[0]] - size < room[order[-1]]:
                turns, each = order, rounds
            else:
                second = room[order[1]] if len(order) > 1 else float("-inf")
                turns, each = order[:1], max(1, min(many - place, int((room[order[0]] - second) // size)))
            for s in turns:
                room[s] -= each * size
            rows.append((size, place, place + each * len(turns) - 1, turns))
            place += each * len(turns)
    return rows


def ranked_by_size(sizes: DataFrame) -> DataFrame:
    """Add ``place``: the rank from 0 among components of equal ``n``, by id.

    Rows are dealt in ranges of (n, id), ranked within each range, and shifted by the rows
    of the same size in the ranges before, so a size that most components have is not one task's.
    """
    dealt = checkpointed(sizes.repartitionByRange("n", "component").withColumn("_range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_range", "n").orderBy("component")) - 1
    per = dealt.groupBy("_range", "n").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("n").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(per.select("_range", "n", before.alias("_before")), ["_range", "n"]).withColumn("place", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def greedy_partition(sizes: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """(component, n, split): the largest components first, each to the split with most room.

    ``sizes`` has a row for each component. The rule looks at one component after another,
    but equal sizes are alike, so the driver folds the list of different sizes with their
    multiplicities, which grows with the root of the rows at most, in a few runs for each.
    Ties go to the earlier split; components of a size are taken by id.
    """
    many = [(r["n"], r["many"]) for r in sizes.groupBy("n").agg(F.count("*").alias("many")).collect()]
    plan = sizes.sparkSession.createDataFrame(greedy_runs(many, splits), "n long, low long, high long, turns array<string>")
    ranked = ranked_by_size(sizes)
    found = ranked.join(F.broadcast(plan), "n").where(F.col("place").between(F.col("low"), F.col("high")))  # a few rows for each different size
    return found.select("component", "n", F.get("turns", F.pmod(F.col("place") - F.col("low"), F.size("turns")).cast("int")).alias("split"))


def leakage(df: DataFrame, split: str, relations: list[str]) -> DataFrame:
    """relation, values, leaked (in more than one split), rows of leaked values; nulls apart."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).cast("string").alias("value")) for r in relations])).alias("x")).select(split, "x.*").where("value IS NOT NULL")
    per = long.groupBy("relation", "value").agg((F.min(split) != F.max(split)).alias("leaks"), F.count("*").alias("n"))
    return per.groupBy("relation").agg(F.count("*").alias("n_values"), F.count(F.when(F.col("leaks"), 1)).alias("n_leaked"), F.sum(F.when(F.col("leaks"), F.col("n")).otherwise(0)).cast("long").alias("rows_of_leaked"))


def leaked_rows(df: DataFrame, split: str, relation: str, *detail: str) -> DataFrame:
    """(relation, split, detail): every row of a value that is in more than one split."""
    bad = df.where(F.col(relation).isNotNull()).groupBy(relation).agg((F.min(split) != F.max(split)).alias("leaks")).where("leaks").select(relation)
    return df.join(bad, relation).select(relation, split, *detail)


def split_profile(df: DataFrame, split: str, category: str) -> DataFrame:
    """split, category, n and percent within the split."""
    n = df.groupBy(split, category).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def split_drift(df: DataFrame, split: str, categories: dict[str, Column], fractions: dict[str, Column] | None = None) -> DataFrame:
    """(split, metric, value, whole, drift): diversity and shares of each split against all rows with one."""
    rows = df.where(F.col(split).isNotNull())
    each, whole = compare.snapshot(rows, categories, fractions, None, split), compare.snapshot(rows, categories, fractions)
    return each.join(whole.withColumnRenamed("value", "whole"), "metric").select(split, "metric", "value", "whole", (F.col("value") - F.col("whole")).alias("drift"))


def cut_components(df: DataFrame, component: str, split: str) -> DataFrame:
    """One row: components, those in several splits, rows in them."""
    per = df.groupBy(component).agg((F.min(split) != F.max(split)).alias("cut"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("components"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.coalesce(F.sum(F.when(F.col("cut"), F.col("n"))), F.lit(0)).cast("long").alias("rows_in_cut"))


def largest_component(df: DataFrame, component: str) -> DataFrame:
    """One row: the largest component, its rows and share."""
    sizes = df.groupBy(component).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), component).limit(1)
    return top.crossJoin(sizes.agg(F.sum("n").alias("total"))).select(component, "n", (F.col("n") / F.col("total")).alias("share"))  # one row each
