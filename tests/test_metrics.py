"""Metrics against published values and against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.functions import metrics as M

# fixed values: published histograms and the metrics published with them
CLASSES = {"other_protein": 7734, "viral": 6258, "immune_receptor": 505, "enzyme": 433, "unknown_or_other": 220, "cancer_associated": 197, "bacterial": 142, "nucleic_acid_or_carbohydrate": 102}
FAMILIES = {"IGHV1": 7986, "IGHV3": 5454, "unknown": 2016, "IGHV4": 1592, "IGHV5": 1004, "IGHV2": 586, "IGHV14": 328, "IGHV6": 249, "IGHV9": 226, "IGHV7": 211, "IGHV8": 122, "IGHV10": 68, "IGHV13": 4, "IGHV12": 2}
LENGTHS = {3: 36, 4: 24, 5: 144, 6: 187, 7: 303, 8: 467, 9: 802, 10: 915, 11: 1444, 12: 1909, 13: 1811, 14: 2626, 15: 1566, 16: 1385, 17: 1143, 18: 1038, 19: 807, 20: 883, 21: 923, 22: 481, 23: 311, 24: 167, 25: 102, 26: 289, 27: 19, 28: 25, 29: 8, 30: 6, 31: 10, 33: 13, 34: 2, 35: 2}
POPULATIONS = """
3 2 0 0;4 9 0 0;5 34 3894 3785;6 25 19048 8615;7 69 11729 9712;8 147 29527 21026;9 253 55923 43493;10 315 94761 75143;11 628 136710 117320;12 787 176303 156281;13 797 204901 183067
14 1263 230757 223666;15 799 219667 214946;16 833 181260 192146;17 576 154951 170718;18 547 135623 151459;19 469 101909 119039;20 555 81963 95615;21 446 55228 69346;22 312 37957 50901
23 214 29669 34125;24 119 15255 23383;25 73 8814 14727;26 262 6463 8807;27 7 3588 5005;28 25 1608 3148;29 8 1007 1938;30 6 921 1033;31 5 233 623;32 0 196 432;33 13 75 251;34 2 39 120;35 2 21 130
"""


def frame(spark, counts):
    return spark.createDataFrame([(str(k), int(v)) for k, v in counts.items()], "k string, n long")


@pytest.mark.parametrize(("counts", "entropy", "gini"), [(CLASSES, 1.609823725323466, 0.6826133666859086), (FAMILIES, 2.432782076842797, 0.7078367017907525), (LENGTHS, 4.120741694178954, 0.5835474607013301)])
def test_published_histograms(spark, counts, entropy, gini):
    r = M.summary(frame(spark, counts)).first()
    assert abs(r["entropy_bits"] - entropy) < 1e-9 and abs(r["gini"] - gini) < 1e-9
    assert abs(M.trapezoid_gini(M.lorenz(frame(spark, counts), "k")).first()[0] - gini) < 1e-9


def test_published_length_normalised_entropy(spark):
    assert abs(M.summary(frame(spark, LENGTHS)).first()["normalized_entropy"] - 0.8241483388357909) < 1e-9


@pytest.mark.parametrize(("column", "jsd"), [(2, 0.021629233228825425), (3, 0.01604457705721552)])
def test_published_divergence(spark, column, jsd):
    rows = [list(map(int, x.split())) for x in POPULATIONS.replace("\n", ";").split(";") if x.strip()]
    a, b = frame(spark, {r[0]: r[1] for r in rows if r[1]}), frame(spark, {r[0]: r[column] for r in rows if r[column]})
    assert abs(M.jensen_shannon(M.align(a, b, "k")).first()["jsd"] - jsd) < 1e-9


def test_edges(spark):
    for counts in ({}, {"a": 0}, {"a": 5}):
        r = M.summary(frame(spark, counts)).first()
        if r:
            assert (r["entropy_bits"], r["normalized_entropy"], r["simpson"]) == (0, 0, 0) and r["gini"] == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=2, max_size=12), st.lists(st.integers(1, 50), min_size=2, max_size=12))
def test_properties(spark, a, b):
    x, y = frame(spark, dict(enumerate(a))), frame(spark, dict(enumerate(b)))
    r = M.summary(x).first()
    s = np.sort(a).astype(float)
    assert 0 <= r["gini"] < 1 and abs(r["gini"] - ((2 * (np.arange(1, len(s) + 1) * s).sum() - (len(s) + 1) * s.sum()) / (len(s) * s.sum()))) < 1e-9
    assert 0 <= r["normalized_entropy"] <= 1 + 1e-12 and 0 <= r["simpson"] < 1
    one, two = M.jensen_shannon(M.align(x, y, "k")).first()[0], M.jensen_shannon(M.align(y, x, "k")).first()[0]
    assert -1e-12 <= one <= 1 + 1e-12 and abs(one - two) < 1e-12
    assert abs(M.jensen_shannon(M.align(x, x, "k")).first()[0]) < 1e-12


def test_describe_and_shares(spark):
    v = [1.0, 2.0, 2.0, 9.5]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    r = M.describe(df, "x", below=(2.0,)).first()
    assert abs(r["std_sample"] - np.std(v, ddof=1)) < 1e-12 and abs(r["std_population"] - np.std(v)) < 1e-12 and abs(r["p95"] - np.percentile(v, 95)) < 1e-12 and r["below_2"] == 0.25
    c = frame(spark, {"a": 6, "b": 3, "c": 1})
    assert M.top_share(c, 2, "k").first()["share"] == 0.9
    assert [round(x["fraction"], 6) for x in M.fractions(c).orderBy("k").collect()] == [0.6, 0.3, 0.1]


def test_counts_and_flags(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), ("unknown", "x")], "k string, v string")
    assert {(r["k"], r["n"]) for r in M.counts(df, "k").collect()} == {("a", 2), ("unknown", 1)}
    assert {(r["k"], r["n"]) for r in M.counts(df, "k", fill="UNKNOWN").collect()} == {("a", 2), ("unknown", 1), ("UNKNOWN", 1)}
    assert M.crosstab(df, "k", "v", ["x", "y"]).where("k = 'a'").first()["y"] == 1
    assert sorted(r["shared"] for r in M.shared_flag(df, "v").collect()) == [False, True, True, True]
    many = {r["key"]: (r["keys"], r["with_many"], r["most"]) for r in M.one_to_many(df, "k", "v").collect()}
    assert many == {"k": (2, 1, 2), "v": (2, 1, 2)}
