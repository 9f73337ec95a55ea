"""Runs of true values in masks, and compositions of sequences, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.ranks import null_safe
from ledgerlens.sources.stage import checkpointed


def true_runs(mask: Column) -> Column:
    """array<struct<first,last>> of 0-based places, both inside, of contiguous true values."""
    on = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    places = F.when(F.size(mask) > 0, F.sequence(F.lit(0), F.size(mask) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda i: on(i) & ((i == 0) | ~on(i - 1)))
    lasts = F.filter(places, lambda i: on(i) & ~on(i + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def last_run(runs: Column) -> Column:
    return F.try_element_at(runs, F.lit(-1))


def third_or_last(runs: Column) -> Column:
    """The third run, or the last of fewer."""
    return F.when(F.size(runs) >= 3, F.get(runs, F.lit(2))).otherwise(last_run(runs))


def labelled_from_end(runs: Column, labels: tuple[str, ...] = ("1", "2", "3")) -> Column:
    """map label -> run, the last run having the last label; null where there are more runs."""
    names = F.array(*[F.lit(x) for x in labels])
    n = F.size(runs)
    return F.when(n == 0, F.map_from_arrays(F.array().cast("array<string>"), runs)).when(n <= len(labels), F.map_from_arrays(F.slice(names, F.lit(len(labels) + 1) - n, n), runs))


def cut_text(text: Column, run: Column) -> Column:
    """The letters of a run."""
    return F.substring(text, run["first"] + 1, run["last"] - run["first"] + 1)


def cut_array(values: Column, run: Column) -> Column:
    return F.slice(values, run["first"] + 1, run["last"] - run["first"] + 1)


def masked_letters(text: Column, mask: Column, alphabet: str) -> Column:
    """Letters of the alphabet where the mask is true."""
    pairs = F.arrays_zip(F.split(text, "").alias("c"), mask.alias("m"))
    kept = F.filter(pairs, lambda p: F.coalesce(p["m"], F.lit(False)) & p["c"].isin(*alphabet))
    return F.transform(kept, lambda p: p["c"])


def composition(df: DataFrame, text: str, alphabet: str, *by: str) -> DataFrame:
    """Letters of the alphabet by group: (by, letter, n)."""
    letters = df.select(*by, F.explode(F.split(F.col(text), "")).alias("letter"))
    return letters.where(F.col("letter").isin(*alphabet)).groupBy(*by, "letter").agg(F.count("*").alias("n"))


def letter_counts(text: Column, alphabet: str) -> list[Column]:
    """Counts of each letter in a text, without exploding it."""
    return [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long").alias(f"n_{c}") for c in alphabet]


def fold_change(frame: DataFrame, group: str, a: str, b: str, digits: int = 6) -> DataFrame:
    """letter, share in group a, share in group b, fold a/b (null where b is 0)."""
    n = lambda g: F.sum(F.when(F.col(group) == g, F.col("n")).otherwise(0))
    wide = frame.groupBy("letter").agg(n(a).alias("_a"), n(b).alias("_b"))
    whole = Window.partitionBy(F.lit(0))  # over letters
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(whole))
    wide = wide.select("letter", share("_a").alias("p_a"), share("_b").alias("p_b"))
    return wide.select("letter", F.round("p_a", digits).alias("share_a"), F.round("p_b", digits).alias("share_b"), F.round(F.try_divide("p_a", F.nullif("p_b", F.lit(0.0))), digits).alias("fold"))


def row_runs(df: DataFrame, flag: Column, key: str, *order: str) -> DataFrame:
    """Gaps and islands over rows: (key, first row number, last, length) of runs of a true flag.

    ``order`` is total within a key; a null flag is false, a null key is a key. Rows are dealt
    in ranges of key and order, so a key of most rows is many tasks': each range finds its own
    runs, rows before a range shift their numbers, and only runs at the ends of ranges, two for
    each range of a key at most, are looked at together and joined where they touch.
    """
    places = [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.col(key).alias("_k"), *[F.col(o).alias(p) for o, p in zip(order, places)], F.coalesce(flag, F.lit(False)).alias("_on"))
    dealt = checkpointed(rows.repartitionByRange("_k", *places).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", "_k")
    on = dealt.select("_range", "_k", "_on", F.row_number().over(own.orderBy(*places)).alias("_n")).where("_on")
    on = on.withColumn("_island", F.col("_n") - F.row_number().over(own.orderBy("_n")))
    local = on.groupBy("_range", "_k", "_island").agg(F.min("_n").cast("long").alias("first"), F.max("_n").cast("long").alias("last"))
    # a row for each range of a key
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range", "_k").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    at_end = (F.col("first") == 1) | (F.col("last") == F.col("_rows"))
    shifted = null_safe(local, sizes, ["_range", "_k"]).select("_k", at_end.alias("_end"), *[(F.col(c) + F.col("_before")).alias(c) for c in ("first", "last")])
    follows = Window.partitionBy("_k").orderBy("first")
    starts = F.coalesce(F.col("first") != F.lag("last").over(follows) + 1, F.lit(True)).cast("int")
    ends = shifted.where("_end").withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(follows))
    joined = ends.groupBy("_k", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    whole = shifted.where("NOT _end").select("_k", "first", "last").unionByName(joined)
    return whole.select(F.col("_k").alias(key), "first", "last", (F.col("last") - F.col("first") + 1).alias("length"))


def run_rules(runs: DataFrame, key: str) -> DataFrame:
    """(key, n_runs, longest, last, third_or_last) of the runs of ``row_runs``: the last two are structs (first, last).

    Three runs of a key leave a task for the third; the rest are aggregates.
    """
    run = F.struct("first", "last")
    kept = checkpointed(runs)
    each = kept.groupBy(key).agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.max_by(run, "first").alias("last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    early = kept.withColumn("_place", place).where("_place <= 3").groupBy(key).agg(F.max_by(run, "_place").alias("third_or_last"))
    return null_safe(each, early, [key])


def joined_chains(heavy: Column, light: Column, cap: int = 280) -> Column:
    """Struct (values, truncated): the arrays one after the other, cut at the cap."""
    both = F.concat(heavy, F.coalesce(light, F.slice(heavy, 1, 0)))
    return F.struct(F.slice(both, 1, cap).alias("values"), (F.size(both) > cap).alias("truncated"))
