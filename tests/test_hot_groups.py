"""Operators over groups that may hold most rows, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.operators import geometry, graph, joins
from ledgerlens.plans import catalogue, compare
from tests.oracle import assert_equal


def brute_runs(rows):
    found = set()
    for key in {k for k, _, _ in rows}:
        flags = [bool(on) for _, _, on in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        at = 1
        for on, group in itertools.groupby(flags):
            n = len(list(group))
            if on:
                found.add((key, at, at + n - 1, n))
            at += n
    return found


@pytest.mark.parametrize("share", [0.0, 0.3, 0.97, 1.0])
def test_runs_cross_the_ends_of_ranges(spark, share):
    rng = random.Random(5)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), i, rng.choice([True, True, None]) if rng.random() < 0.02 else rng.random() < share) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, on boolean").withColumn("first", F.lit(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = R.row_runs(df, F.col("on"), "k", "n")
        got = {tuple(r) for r in runs.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_runs(rows)
    rules = {r["k"]: r for r in R.run_rules(runs, "k").collect()}
    for key in {k for k, *_ in got}:
        mine = sorted(g[1:] for g in got if g[0] == key)
        r = rules[key]
        assert (r["n_runs"], r["longest"], tuple(r["last"]), tuple(r["third_or_last"])) == (len(mine), max(m[2] for m in mine), mine[-1][:2], mine[min(len(mine), 3) - 1][:2])
    assert len(rules) == len({k for k, *_ in got})


def test_runs_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, n int, on boolean")
    assert not R.run_rules(R.row_runs(df, F.col("on"), "k", "n"), "k").count()


def brute_choices(rows, seeds):
    out = set()
    for seed in range(seeds):
        for cluster in {c for c, _, _ in rows}:
            key, value = min(((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k, v) for c, k, v in rows if c == cluster))[1:]
            out.add((seed, cluster, key, value))
    return out


def test_choices_by_vectors_of_minima(spark, monkeypatch):
    rows = [("hot", i, f"v{i % 7}") for i in range(200)] + [(None, 500, "x"), (None, 501, "y"), ("one", 502, "z"), ("twice", 503, "p"), ("twice", 503, "q")]
    df = spark.createDataFrame(rows, "c string, id int, v string")
    want = brute_choices(rows, 23)
    for at_once in (100, 5):
        monkeypatch.setattr(compare, "SEEDS_AT_ONCE", at_once)
        found = [tuple(r) for r in compare.random_representatives(df, "c", "id", 23, "v").collect()]
        assert set(found) == want and len(found) == len(want)
    assert not compare.random_representatives(df.limit(0), "c", "id", 3).count()


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_pairs_in_tiles(spark, tile):
    rows = [("hot", i) for i in range(60)] + [("cold", i) for i in range(60, 64)] + [("hot", 3), (None, 80), (None, 81), ("alone", 90)]
    df = spark.createDataFrame(rows, "c string, id int").withColumn("v", F.col("id") * 10).withColumn("a", F.lit(1))
    got = sorted(tuple(r) for r in joins.pairs_within(df, ["c"], "id", "v", tile).collect())
    want = sorted((c, x, x * 10, y, y * 10) for c in ("hot", "cold", "alone") for x in [i for k, i in rows if k == c] for y in [i for k, i in rows if k == c] if x < y)
    assert got == want


def sent_records(spark):
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_do_not_send_a_row_for_each_block(spark):
    n = 6000
    df = spark.range(n).select("id", F.lit("hot").alias("c"), (F.col("id") % 7).alias("v"))
    before = sent_records(spark)
    found = joins.pairs_within(df, ["c"], "id", "v").agg(F.count("*").alias("n"), F.sum("value_b").alias("v")).first()
    assert found["n"] == n * (n - 1) // 2 and found["v"] == sum(i * (i % 7) for i in range(n))
    assert sent_records(spark) - before < 2 * n


def test_rotated_copies_have_no_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 3))
    rows = []
    for i in range(9):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q[:, 0] *= np.sign(np.linalg.det(q))
        rows.append(("same", i, (base @ q + rng.normal(size=3)).tolist()))
    rows.append(("same", 9, (base * [1, 1, -1]).tolist()))
    rows.append(("same", 10, base[:5].tolist()))
    df = spark.createDataFrame(rows, "c string, id int, p array<array<double>>")
    got = {(r["a"], r["b"]): r["rmsd"] for r in geometry.pair_rmsd(df, "c", "id", "p", tile=3).collect()}
    assert set(got) == {(a, b) for a in range(10) for b in range(a + 1, 10)}
    assert all(d < 1e-6 for (_, b), d in got.items() if b < 9) and all(got[a, 9] > 0.1 for a in range(9))


def test_least_squares_by_pairs_of_levels(spark):
    rng = np.random.default_rng(11)
    t, a, b, c = rng.integers(0, 2, 900), rng.integers(0, 6, 900), rng.integers(0, 9, 900), rng.integers(0, 4, 900)
    y = 1.5 * t + 0.3 * a - 0.2 * b + (c == 2) + rng.normal(size=900)
    df = spark.createDataFrame([(float(q), int(w), f"a{e}", int(r), f"c{u}") for q, w, e, r, u in zip(y, t, a, b, c)], "y double, t int, a string, b int, c string")
    fit = S.ols_effect(df, "y", "t", ["a", "b", "c"])
    x = np.column_stack([np.ones(900), t, *[(col == v) for col in (a, b, c) for v in sorted(set(col.tolist()))[1:]]]).astype(float)
    beta, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
    error = np.sqrt(rest[0] / (900 - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert len(fit["columns"]) == x.shape[1] == 18 and abs(fit["coefficient"] - beta[1]) < 1e-9 and abs(fit["high"] - (beta[1] + 1.96 * error)) < 1e-9
    with pytest.raises(ValueError, match="19 levels"):
        S.ols_effect(df, "y", "t", ["a", "b", "c"], most_levels=18)
    empty = S.ols_effect(df.limit(0), "y", "t", ["a", "b"])
    assert empty["rows"] == 0 and empty["coefficient"] is None
    assert S.ols_effect(df, "y", "t", [])["rows"] == 900


def test_many_levels_are_not_multiplied(spark):
    rows = spark.range(30000).select((F.col("id") % 2).alias("t"), *[(F.xxhash64("id", F.lit(s)) % 500).alias(f"c{s}") for s in range(3)])
    df = rows.withColumn("y", 3.0 * F.col("t") + F.col("c0") * 0.01)
    fit = S.ols_effect(df, "y", "t", ["c0", "c1"])
    assert abs(fit["coefficient"] - 3) < 1e-6 and fit["rows"] == 30000


def test_leaked_rows_are_rows(spark):
    df = spark.createDataFrame([("train", "x", 1), ("test", "x", 2), ("test", "x", 2), ("test", "y", 3), ("train", None, 4), ("test", None, 5)], "split string, v string, id int")
    assert sorted(tuple(r) for r in graph.leaked_rows(df, "split", "v", "id").collect()) == [("x", "test", 2), ("x", "test", 2), ("x", "train", 1)]


def test_one_row_of_a_key_leaves_a_task(spark):
    plan = joins.keep_one(spark.range(100).withColumn("k", F.col("id") % 2), ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_gaps_of_pairs_are_rounded_as_in_sql(spark, tmp_path):
    prices = [0.0, 0.00015, 0.00005, 1.00005, -2.00025, 123456.78905, 4.9999999999999996e-05, 4503599627370497.0, 1e18, 1e304, 1e305, float("nan"), None]
    rows = [(i, "b", "t", p) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.QUERIES["pair_join_within_cluster"](spark, str(tmp_path))
    assert df.count() == len(prices) * (len(prices) - 1) // 2
    assert_equal(df, con, catalogue.ORACLES["pair_join_within_cluster"])


def test_rounding_away_from_zero(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, 4503599627370497.0, -9007199254740993.0, 1e308, float("inf"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(S.round_away(F.col("x"), 0)).collect()]
    assert got == [1.0, 2.0, 3.0, -1.0, -2.0, -3.0, 0.0, 4503599627370497.0, -9007199254740993.0, 1e308, float("inf"), float("-inf"), None]
