"""Exclusion funnels: the first failing gate names a row's stage; stages are counted and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import text as T

#: stages of the structure funnel, and why rows leave there
REASONS = {
    "ok": "kept",
    "missing_pdb": "no structure file was available",
    "cached": "an output of an earlier run exists; not an exclusion",
    "parse_error": "the structure file cannot be parsed",
    "non_numeric_model_id": "the model is no whole number, and none is guessed",
    "atom_serial_overflow": "more atoms than the format's serial number can count",
    "missing_H_chain": "the named heavy chain is not in the structure",
    "short_H": "the heavy chain has under 10 residues",
    "too_few_coords": "under 3 resolved coordinates",
    "no_cdr_positions": "no residue lies in a loop",
    "h3_too_long": "the third loop is longer than the window",
    "h3_too_short": "the third loop is shorter than the window",
    "unhandled_exception": "an error that no rule names",
}
MOST_ATOMS = 99_999


def stage(gates: list[tuple[str, Column]], kept: str = "ok") -> Column:
    """The name of the first gate that holds."""
    out = None
    for name, fails in gates:
        fails = F.coalesce(fails, F.lit(False))
        out = F.when(fails, F.lit(name)) if out is None else out.when(fails, F.lit(name))
    return F.lit(kept) if out is None else out.otherwise(F.lit(kept))


def structure_gates(low: int = 3, high: int = 35) -> list[tuple[str, Column]]:
    """Gates over found, error, atoms, model, heavy_found, heavy_length, coords, loop_positions, h3_length."""
    return [
        ("missing_pdb", ~F.col("found")),
        ("atom_serial_overflow", F.contains("error", F.lit("invalid literal")) & (F.col("atoms") > MOST_ATOMS)),
        ("non_numeric_model_id", ~T.is_whole_number(F.col("model"))),
        ("parse_error", F.col("error").isNotNull()),
        ("missing_H_chain", ~F.col("heavy_found")),
        ("short_H", F.col("heavy_length") < 10),
        ("too_few_coords", F.col("coords") < 3),
        ("no_cdr_positions", F.col("loop_positions") == 0),
        ("h3_too_long", F.col("h3_length") > high),
        ("h3_too_short", F.col("h3_length") < low),
    ]


def clamp_model(model: Column, count: Column) -> Column:
    """The model's index, at most the last; null where it is no whole number."""
    index = model.try_cast("int")
    return F.when(index.isNotNull(), F.least(index, count - 1))


def over_cap(length: Column, cap: int = 280) -> Column:
    """A monitor that never drops a row."""
    return length > cap


def report(df: DataFrame, stage_col: str = "stage", reasons: dict[str, str] | None = None) -> DataFrame:
    """(stage, n, justification), numbered stages as their family, most rows first."""
    known = F.create_map(*[F.lit(x) for kv in (reasons or REASONS).items() for x in kv])
    n = df.groupBy(T.stage_family(F.col(stage_col)).alias("stage")).agg(F.count("*").alias("n"))
    return n.withColumn("justification", F.coalesce(F.try_element_at(known, F.col("stage")), F.lit("unrecognised stage"))).orderBy(F.desc("n"), "stage")


def exclude(master: DataFrame, bad: DataFrame, key: str, log: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The table without the bad rows, and the log with them; refuses to run twice."""
    if log.where(F.col("stage") == name).limit(1).count():
        raise ValueError(f"stage {name} was applied before")
    gone = master.join(bad.select(key), key, "left_semi")
    return master.join(bad.select(key), key, "left_anti"), log.unionByName(gone.withColumn("stage", F.lit(name)).select(*[c for c in gone.columns if c in log.columns], "stage"), allowMissingColumns=True)
