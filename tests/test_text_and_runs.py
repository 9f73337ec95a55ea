from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import runs as R
from ledgerlens.functions import text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "want"), [("04/15/69", 2069), ("04/15/70", 1970), ("bad", None), (None, None), ("1/2", None), ("1/2/xx", None), ("01/01/00", 2000)])
def test_year(spark, value, want):
    assert one(spark, T.year_of, value) == want


@pytest.mark.parametrize(("value", "want"), [("A[MSE]C", "AMC"), ("[XYZ]A", "XA"), ("A[CC", "AXCC"), ("", ""), ("[SEP][TPO]", "ST"), ("[]A", "XA")])
def test_residues(spark, value, want):
    assert one(spark, T.clean_residues, value) == want


def test_cells(spark):
    get = lambda v: [(c["pdb"], c["h"], c["l"]) for c in one(spark, T.structure_cell, v)]
    assert get("6V4P:CD") == [("6v4p", "C", "D")] and get("x:AB;y:CD") == [("x", "A", "B"), ("y", "C", "D")] and get("p:A") == [("p", "A", None)]
    assert [get(v) for v in ("na", "None", "", None, "nochains")] == [[]] * 5


def test_names(spark):
    assert one(spark, T.null_if_token, " NA ") is None and one(spark, T.null_if_token, " x ") == "x"
    assert one(spark, T.first_part, "NA | b") == "b" and one(spark, T.first_part, "|") is None
    assert one(spark, lambda c: T.stem_parts(c)["antigen"], "1abc_agA_B_m0") == "A_B" and one(spark, lambda c: T.stem_parts(c)["pdb"], "plain") is None
    assert one(spark, T.bare_pdb_id, "PDB_00001ABC") == "1abc" and one(spark, T.gene_family, "IGHV3-23*01") == "IGHV3" and one(spark, T.gene_family, "x") is None
    assert one(spark, T.stage_family, "h3_too_long_42") == "h3_too_long" and one(spark, lambda c: T.length_stage(c)["length"], "h3_too_long_42") == 42
    assert one(spark, lambda c: T.id_parts(c)["ag"], "1abc_H_L_A") == "A" and one(spark, lambda c: T.id_parts(c)["ag"], "1abc_H") is None
    assert [one(spark, T.is_whole_number, v) for v in ("-3", "3", "H", "3.0")] == [True, True, False, False]
    assert [one(spark, T.number, v) for v in ("1.5", "NA", "NaN", "inf")] == [1.5, None, None, None]
    assert one(spark, T.sha8, "abc") == "ba7816bf" and [one(spark, T.truthy, v) for v in ("True", "false", None, "x")] == [True, False, False, False]
    assert one(spark, T.residue_letter, "dg ") == "G" and one(spark, T.residue_letter, "ABC") == "[ABC]"
    assert [r for r in one(spark, T.tags, "A[MSE]B[X]")] == ["MSE", "X"]


def test_classes(spark):
    rules = T.Rules((("bact", (T.Keyword("toxin", inside=True, unless=("anatoxin",)), T.Keyword("bacteri"))), ("cancer", (T.Keyword("tumor", unless=("tumor necrosis",)), T.Keyword("cd20")))), "other")
    get = lambda v: one(spark, lambda c: T.classify(c, rules), v)
    assert [get(v) for v in ("neurotoxin", "anatoxin", "bacterial", "bacteri", "Tumor x", "tumor necrosis factor", "cd200", "(CD20)", None, "")] == ["bact", "other", "other", "bact", "cancer", "other", "other", "cancer", "other", "other"]


def test_translation(spark):
    assert one(spark, lambda c: T.translate_frame(c, 0), "ATGGCC-TAA") == "MA*"
    best = one(spark, T.best_frame, "ATGGCCTAAATGG")
    assert best["aa"] and best["stops"] >= 0
    j = one(spark, lambda c: T.best_frame(c, T.J_MOTIF), "ATTTGGCCAGGGA")
    assert (j["aa"], j["frame"], j["ambiguous"]) == ("FGQG", 1, False)
    none = one(spark, lambda c: T.best_frame(c, T.J_MOTIF), "AAAAAAAAA")
    assert none["ambiguous"]


@pytest.mark.parametrize(("mask", "want"), [([], []), ([False], []), ([True], [(0, 0)]), ([True, True, False, True], [(0, 1), (3, 3)]), ([None, True, None, True, True], [(1, 1), (3, 4)]), ([False, True, False, True, False, True, True, False, True], [(1, 1), (3, 3), (5, 6), (8, 8)])])
def test_runs(spark, mask, want):
    row = spark.createDataFrame([(mask,)], "m array<boolean>").select(R.true_runs(F.col("m")).alias("r")).select("r", R.last_run(F.col("r")).alias("last"), R.third_or_last(F.col("r")).alias("third"), R.labelled_from_end(F.col("r")).alias("named")).first()
    pair = lambda r: r and (r["first"], r["last"])
    assert [pair(r) for r in row["r"]] == want
    assert pair(row["last"]) == (want[-1] if want else None) and pair(row["third"]) == (want[2] if len(want) >= 3 else want[-1] if want else None)
    if len(want) > 3:
        assert row["named"] is None
    else:
        assert {k: pair(v) for k, v in row["named"].items()} == dict(zip("123"[3 - len(want) :], want))


def test_letters(spark):
    df = spark.createDataFrame([("AAC", [True, False, True]), ("xA", [True, None])], "s string, m array<boolean>")
    assert [r[0] for r in df.select(R.masked_letters(F.col("s"), F.col("m"), "AC")).collect()] == [["A", "C"], []]
    assert {(r["letter"], r["n"]) for r in R.composition(df, "s", "AC").collect()} == {("A", 3), ("C", 1)}
    cut = spark.sql("SELECT 'abcdef' AS s, named_struct('first', 1, 'last', 3) AS r, array(1,2,3,4) AS a").select(R.cut_text(F.col("s"), F.col("r")), R.cut_array(F.col("a"), F.col("r")), R.joined_chains(F.col("a"), F.lit(None).cast("array<int>"), 3)).first()
    assert cut[0] == "bcd" and cut[1] == [2, 3, 4] and cut[2]["values"] == [1, 2, 3] and cut[2]["truncated"]


def test_antigen_classes(spark):
    from ledgerlens.plans import antigens

    cases = {"Spike glycoprotein": "viral", "CD320 antigen": "other_protein", "T-cell CD3 epsilon": "immune_receptor", "il-6 receptor": "immune_receptor", "il- x": "other_protein", "botulinum neurotoxin": "bacterial", "alpha-cobratoxin": "other_protein", "tumor necrosis factor": "immune_receptor", "RNase A": "enzyme", "bacterial protein": "other_protein", None: "other_protein"}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.classify(F.col("x"), antigens.RULES).alias("c")).collect()
    assert {r["x"]: r["c"] for r in got} == cases
