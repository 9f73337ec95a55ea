from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import stats as S
from ledgerlens.operators import align, dedup, geometry, graph, joins, sampling
from ledgerlens.plans import audits, compare, funnel
from ledgerlens.sources.contracts import ContractError


def test_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None, 10), (1, None, 11), (2, "x", 12)], "k int, v string, z int")
    got = {(r["k"], r["z"], r["fan_out"]) for r in joins.null_safe_join(a, b, ["k", "v"], "z").collect()}
    assert got == {(1, 10, 2), (2, 12, 1)}
    with pytest.raises(ValueError):
        joins.one_to_one_join(a, b, ["k"])
    inner, lost = joins.checked_inner_join(a, b.where("k = 1"), ["k"])
    assert inner.count() == 2 and lost.first()["lost"] == 1
    with pytest.raises(ValueError):
        joins.require_none(a, "rows")
    for tile in (1, 3):
        pairs = joins.pairs_within(spark.range(20).withColumn("c", F.col("id") % 2), ["c"], "id", "id", tile)
        assert pairs.count() == 2 * 45 and pairs.distinct().count() == 90
    many = spark.createDataFrame([("c", 1), ("c", 1), ("c", 2)], "c string, n int")
    assert tuple(joins.pair_counts(many, "c", "n").first())[1:] == (1, 3, 2)


def test_components_are_the_transitive_closure(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for i in range(120)] + [(1000 + i, 1000 + i // 2, 2000 + (i + 1) // 2) for i in range(60)]
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for c in (1, 2):
        first = {}
        for r in rows:
            if r[c] is not None:
                x, y = root(r[0]), root(first.setdefault(r[c], r[0]))
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "id long, a int, b int")
    assert {r["id"]: r["component"] for r in graph.components(df, "id", ["a", "b"]).collect()} == {i: root(i) for i in up}


def test_greedy_partition_equals_the_fold(spark):
    rng = random.Random(3)
    for sizes in ([rng.randint(1, 9) for _ in range(80)], [50] + [1] * 30, [3], [2] * 9):
        rows = list(enumerate(sizes))
        room, want = {s: f * sum(sizes) for s, f in graph.SPLITS}, {}
        for i, n in sorted(rows, key=lambda r: (-r[1], r[0])):
            best = max(room, key=lambda s: room[s])
            want[i], room[best] = best, room[best] - n
        got = {r["component"]: r["split"] for r in graph.greedy_partition(spark.createDataFrame(rows, "component long, n long")).collect()}
        count = lambda d: sorted((d[i], n) for i, n in rows)
        assert got.keys() == want.keys()
        load = lambda d: {s: sum(n for i, n in rows if d[i] == s) for s, _ in graph.SPLITS}
        assert max(abs(load(got)[s] - load(want)[s]) for s, _ in graph.SPLITS) <= max(sizes), (count(got), count(want))


def identity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDE") for _ in range(rng.choice([3, 4, 8, 20, 40]))) for _ in range(25)]
    words = base + ["".join(c if rng.random() > 0.06 else rng.choice("ACDE") for c in w) for w in base for _ in range(3)] + base
    df = spark.createDataFrame(list(enumerate(words)), "id int, s string")
    want = {(a, b) for a in set(words) for b in set(words) if a < b and identity(a, b) >= 0.85 - 1e-12}
    assert {(r["a"], r["b"]) for r in dedup.similar_pairs(df, "s", 0.85).collect()} == want
    rows = dedup.near_clusters(df, "s", 0.85).collect()
    assert len(rows) == len(words) and len({(r["s"], r["cluster_rep"]) for r in rows}) == len(set(words))
    assert all(r["s"] == r["cluster_rep"] or tuple(sorted((r["s"], r["cluster_rep"]))) in want for r in rows)
    assert all(r["cluster_rep"] == {x["s"]: x["cluster_rep"] for x in rows}[r["cluster_rep"]] for r in rows)


def test_representatives(spark):
    df = spark.createDataFrame([("a", 2, True), ("a", 1, False), ("b", 3, False)], "c string, id int, bound boolean")
    assert sorted(r["id"] for r in dedup.representatives(df, "c", F.desc("bound"), "id").collect()) == [2, 3]
    many = dedup.random_representatives(df, "c", "id", 30)
    assert many.count() == 60 and many.where("c = 'a'").select("id").distinct().count() == 2
    assert dedup.cluster_sizes(df, "c", "c").first()["singletons"] == 1


def test_sampling(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1000)], "s string, n long")
    got = {r["s"]: r["allocated"] for r in sampling.proportional_allocation(sizes, "s", "n", 100).collect()}
    assert sum(got.values()) == 100 and got["c"] >= 98
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    assert sampling.sample(df, "id", 40).count() == 40
    assert {r["count"] for r in sampling.stratified(df, "g", "id", 7).groupBy("g").count().collect()} == {7}
    drawn = sampling.disjoint_strata(df, "id", [("a", df, 100, 1), ("b", df, 100, 1), ("c", df.where("g = 0"), 50, 2)])
    assert drawn.count() == drawn.select("id").distinct().count() == 250


def test_kabsch_and_contacts(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(4, 9, 3))
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    turn = q * np.sign(np.linalg.det(q))
    assert np.allclose(geometry.kabsch_rmsd(p, p @ turn + 3.0), 0, atol=1e-6)
    assert (geometry.kabsch_rmsd(p, p * np.array([1, 1, -1])) > 0.1).all()
    rows = [(i, "c" if i < 6 else "d", rng.normal(size=(5, 3)).tolist()) for i in range(8)] + [(9, "c", rng.normal(size=(4, 3)).tolist()), (10, "c", None)]
    df = spark.createDataFrame(rows, "id int, c string, p array<array<double>>")
    assert geometry.pair_rmsd(df, "c", "id", "p", tile=2).count() == 15 + 1
    assert geometry.pair_rmsd(df, "c", "id", "p", max_size=6).count() == 1 and geometry.skipped_clusters(df.where("p IS NOT NULL"), "c", 6).first()["n"] == 7
    atoms = [("s", i // 3, "ACD"[i // 3 % 3], *map(float, rng.normal(size=3) * 5)) for i in range(30)]
    targets = [("s", *map(float, rng.normal(size=3) * 5)) for _ in range(40)] + [("t", 0.0, 0.0, 0.0)]
    got = {x["residue"]: x["min_dist"] for x in geometry.contact_distances(spark.createDataFrame(atoms, "pdb_id string, residue int, aa string, x double, y double, z double"), spark.createDataFrame(targets, "pdb_id string, x double, y double, z double")).collect()}
    t = np.array([x[1:] for x in targets[:-1]])
    for res in range(10):
        a = np.array([x[3:] for x in atoms if x[1] == res])
        assert abs(got[res] - np.sqrt(((a[:, None] - t[None]) ** 2).sum(2)).min()) < 1e-9


def score_brute(q, r, o=10.0, e=0.5):
    n, m, low = len(q), len(r), -1e9
    h, x, y = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    a, b = align.encode(q), align.encode(r)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x[i, j] = max(h[i, j - 1] - o, x[i, j - 1] - e)
            y[i, j] = max(h[i - 1, j] - o, y[i - 1, j] - e)
            h[i, j] = max(0, h[i - 1, j - 1] + align.MATRIX[a[i - 1], b[j - 1]], x[i, j], y[i, j])
    return h.max()


def test_alignment(spark):
    rng = random.Random(6)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    for _ in range(40):
        q, r = ("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(2))
        if rng.random() < 0.5:
            r = q[:5] + r[:4] + q[5:]
        score, matches, pairs = align.local_alignment(q, r)
        assert abs(score - score_brute(q, r)) < 1e-9 and 0 <= matches <= pairs <= min(len(q), len(r))
    assert (align.MATRIX == align.MATRIX.T).all()
    gene = "".join(rng.choice(letters) for _ in range(98))
    query = "".join("A" if i in (60, 70, 80) else c for i, c in enumerate(gene))
    decoy = gene[:50] + "".join(rng.choice(letters) for _ in range(48))
    refs = spark.createDataFrame([("decoy", decoy), ("true", gene), ("z_true", gene)], "gene_id string, seq string")
    rows = {r["id"]: r for r in align.best_matches(spark.createDataFrame([(1, query), (2, "AC"), (3, None)], "id int, seq string"), refs).collect()}
    assert rows[1]["gene_id"] == "true" and rows[1]["coverage"] > 0.95 and rows[2]["gene_id"] is None and rows[3]["identity"] == 0


def test_inference(spark):
    rng = np.random.default_rng(7)
    rows = [(float(2 * t + {"a": 0, "b": 5, "c": -1}[c] + rng.normal()), t, c) for t, c in zip(rng.integers(0, 2, 400).tolist(), rng.choice(list("abc"), 400).tolist())]
    df = spark.createDataFrame(rows + [(None, 1, "a"), (1.0, 0, None)], "y double, t int, c string")
    fit = S.ols_effect(df, "y", "t", ["c"])
    x = np.array([[1, t, c == "b", c == "c"] for _, t, c in rows], float)
    y = np.array([r[0] for r in rows])
    beta, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
    se = np.sqrt(rest[0] / (400 - 4) * np.linalg.inv(x.T @ x)[1, 1])
    assert fit["rows"] == 400 and abs(fit["coefficient"] - beta[1]) < 1e-9 and abs(fit["low"] - (beta[1] - 1.96 * se)) < 1e-9
    w = spark.sql("SELECT 0L AS h, 0L AS n UNION ALL SELECT 9L, 10L").select(S.wilson(F.col("h"), F.col("n")).alias("w"), "n").orderBy("n").collect()
    assert w[0]["w"] is None and abs(w[1]["w"]["low"] - 0.595849971) < 1e-6 and abs(w[1]["w"]["high"] - 0.982123787) < 1e-6
    profile = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(1, 20, (60, 2)))], "c int, A int, B int")
    ci = {r["column"]: r for r in S.cluster_bootstrap(profile, "c", ["A", "B"], 300).collect()}
    share = profile.agg(F.sum("A") / (F.sum("A") + F.sum("B"))).first()[0]
    assert ci["A"]["low"] < share < ci["A"]["high"] and abs(ci["A"]["median"] + ci["B"]["median"] - 1) < 0.02
    d = S.mean_difference(spark.createDataFrame([("x", 1.0, 50), ("x", 3.0, 50), ("y", 1.0, 100)], "g string, v double, n long"), "g", "v", "n", "x", "y", 500).first()
    assert 0.7 < d["low"] < 1 < d["high"] < 1.3


def test_funnel(spark):
    cols = "found boolean, error string, atoms long, model string, heavy_found boolean, heavy_length int, coords int, loop_positions int, h3_length int"
    ok = (True, None, 10, "0", True, 100, 50, 20, 10)
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(cols.split(", "), ok))
    cases = [("ok", ok), ("missing_pdb", change(found=False)), ("atom_serial_overflow", change(error="invalid literal for int()", atoms=100_000)), ("parse_error", change(error="invalid literal", atoms=5)), ("non_numeric_model_id", change(model="H")), ("short_H", change(heavy_length=9)), ("too_few_coords", change(coords=2)), ("no_cdr_positions", change(loop_positions=0)), ("h3_too_long", change(h3_length=36)), ("h3_too_short", change(h3_length=2)), ("missing_H_chain", change(heavy_found=False))]
    df = spark.createDataFrame([c for _, c in cases], cols)
    assert [r[0] for r in df.coalesce(1).select(funnel.stage(funnel.structure_gates())).collect()] == [n for n, _ in cases]
    log = spark.createDataFrame([("h3_too_long_42",), ("h3_too_long_50",), ("odd",)], "stage string")
    assert [(r["stage"], r["n"], r["justification"]) for r in funnel.report(log).collect()] == [("h3_too_long", 2, funnel.REASONS["h3_too_long"]), ("odd", 1, "unrecognised stage")]
    master, bad = spark.createDataFrame([(1, "p"), (2, "q")], "id int, pdb_id string"), spark.createDataFrame([(2,)], "id int")
    kept, after = funnel.exclude(master, bad, "id", spark.createDataFrame([("z", "ok")], "pdb_id string, stage string"), "patch")
    assert kept.count() == 1 and after.where("stage = 'patch'").first()["pdb_id"] == "q"
    with pytest.raises(ValueError):
        funnel.exclude(master, bad, "id", after, "patch")


def test_migration_and_review(spark):
    from ledgerlens.functions import text as T

    master = spark.createDataFrame([("a", "toxin", True, 3), ("b", "x", False, 2)], "filename_stem string, antigen_name string, has_antigen boolean, cdr3_len_actual int")
    clusters = spark.createDataFrame([("a", "AAA", "a"), ("b", "CC", "b")], "filename_stem string, cdrh3_seq string, cluster_rep string")
    rules = T.Rules((("bact", (T.Keyword("toxin"),)),), "other")
    assert {r["filename_stem"]: r["antigen_class"] for r in audits.migrate(master, clusters, rules).collect()} == {"a": "bact", "b": None}
    with pytest.raises(ValueError):
        audits.migrate(master.withColumn("cdr3_len_actual", F.lit(9)), clusters, rules)
    rows = spark.range(400).select("id", F.when(F.col("id") % 10 < 6, "other").when(F.col("id") % 10 < 9, "p").otherwise("rare").alias("cls"))
    sheet = audits.review_sheet(rows, "id", "cls", 50, 10, 20, "other")
    assert {(r["stratum"], r["count"]) for r in sheet.groupBy("stratum").count().collect()} == {("random", 50), ("rare", 10), ("audit", 20)}
    assert sheet.select("id").distinct().count() == 80
    accuracy, scores, leaked = audits.score_sheet(sheet, "other")
    assert accuracy.first()["rate"] == 1 and leaked.first()["hits"] == 0 and scores.where("class = 'rare'").first()["recall"] == 1


def test_compare(spark):
    df = spark.createDataFrame([(1, "c", "x"), (2, "c", "x"), (3, "d", "y"), (4, None, "z")], "id int, cl string, cat string")
    got = {r["metric"]: r for r in compare.before_after(df, "cl", ["id"], {"cat": F.col("cat")}).collect()}
    assert (got["n_rows"]["before"], got["n_rows"]["after"]) == (4, 3) and got["cat_n_unique"]["absolute_delta"] == 0 and got["cat_gini"]["after"] == 0
    assert audits.checklist({"a": {"n": 3}, "b": None}, [("t", "a", "{n} rows"), ("u", "b", "{n}")]) == [("t", "3 rows"), ("u", "INSUFFICIENT DATA: b")]


def test_external_split(spark):
    master = spark.createDataFrame([("p", "H", None, "c1"), ("q", "H", "L", "c2")], "pdb string, h string, l string, cluster string")
    manifest = spark.createDataFrame([("p", "H", None, "train"), ("q", "H", "L", "test"), ("p", "H", None, "test"), ("z", "H", "L", "test")], "pdb string, h string, l string, split string")
    rows, leaks = audits.external_split(master, manifest, ["pdb", "h", "l"], "split", ["cluster"], "cluster")
    assert rows.count() == 4 and tuple(leaks.first()) == ("cluster", 2, 1, 2)
    with pytest.raises(ContractError):
        audits.external_split(master, manifest.where("pdb = 'z'"), ["pdb", "h", "l"], "split", ["cluster"], "cluster")
