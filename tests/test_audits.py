"""The composite audits and the operators that no catalogue query runs, on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.functions import text as T
from ledgerlens.operators import align, dedup, geometry, graph
from ledgerlens.plans import audits, compare, funnel
from ledgerlens.sources import readers, sinks


def got(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def master(spark):
    rows = [
        ("a", "1", 10, "CARDYW", "c1", True, "spike protein", "protein", False, "A|B", "AC[MSE]", "human", None),
        ("b", "2", 10, "CARDYW", "c1", False, None, None, True, "A", "ACD", "human", "mouse"),
        ("c", "3", 12, "CARDFW", "c1", True, "her2", "protein", True, None, None, None, None),
        ("d", "4", 40, "GGGGGG", "c2", True, "some kinase", "protein", False, "A|B", "[MSE][XXX]", "unknown", None),
        ("e", "5", 3, None, "c3", None, "other", "protein", False, "C", "A", "human", None),
    ]
    return spark.createDataFrame(rows, "filename_stem string, pdb_id string, cdr3_len_actual int, h3_seq string, cluster_rep string, has_antigen boolean, antigen_name string, antigen_type string, is_therapeutic boolean, antigen_chain string, antigen_seq string, heavy_species string, light_species string")


def test_length_and_category_bias(master):
    metrics, spread = audits.length_bias(master)
    assert (metrics.first()["categories"], metrics.first()["total"]) == (3, 4)  # 40 is outside the window
    r = spread.first()
    assert (r["n"], r["mean"], r["median"], r["min"], r["max"]) == (4, 8.75, 10.0, 3.0, 12.0)
    bias = {r["dim"]: r for r in audits.category_bias(master, "heavy_species", "light_species").collect()}
    assert (bias["heavy_species"]["categories"], bias["light_species"]["categories"]) == (3, 2)  # human, unknown, UNKNOWN


def test_redundancy_and_exact_clusters(master, spark):
    rows, one = audits.redundancy(master.drop("cluster_rep"), identity=0.8)
    reps = {r["filename_stem"]: r["cluster_rep"] for r in rows.collect()}
    assert reps.keys() == {"a", "b", "c", "d"} and reps["a"] == reps["b"] == reps["c"] != reps["d"]
    assert (one.first()["n_sequences"], one.first()["n_clusters"], one.first()["largest"]) == (4, 2, 3)
    r = dedup.exact_clusters(master.select("filename_stem", "h3_seq"), "h3_seq", "filename_stem")
    assert got(r, "filename_stem", "cluster_rep") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")]


def test_landscape_and_denominators(master):
    metrics, table = audits.landscape(master)
    assert metrics.first()["total"] == 3
    assert got(table) == [("cancer_associated", 0, 1), ("enzyme", 1, 0), ("viral", 1, 0)]
    assert got(audits.bound_denominators(master), "population", "n_rows", "n_bound") == [("all", 5, 3), ("representatives", 3, 2)]


def test_construction_tags_and_nulls(master):
    assert got(audits.construction(master).where("n_chains > 0"), "n_chains", "n", "tagged") == [(1, 2, 0), (2, 2, 2)]
    assert got(audits.tag_tally(master)) == [("MSE", 2), ("XXX", 1)]
    assert got(audits.null_labels(master, "light_species", "heavy_species"), "heavy_species", "is_null", "n") == sorted([("human", False, 1), ("human", True, 2), (None, True, 1), ("unknown", True, 1)], key=repr)
    assert got(master.select("filename_stem", T.any_tag_in(F.col("antigen_seq"), ("XXX", "ZZZ")).alias("x")).where("x"), "filename_stem") == [("d",)]


def test_label_by_flag(spark):
    rows = [("UNKNOWN", False), ("UNKNOWN", False), ("unknown", True), ("kappa", None)]
    df = spark.createDataFrame(rows, "s string, paired boolean")
    r = audits.label_by_flag(df, "s", "paired").first()
    assert (r["n_upper"], r["n_lower"], r["upper_false"], r["lower_true"], r["clean_split"]) == (2, 1, 2, 1, True)
    assert not audits.label_by_flag(df.unionByName(spark.createDataFrame([("UNKNOWN", None)], df.schema)), "s", "paired").first()["clean_split"]


def test_numbering_check(spark):
    numbered = lambda n: [(104, "C"), *[(105 + i, "A") for i in range(n)], (117, "-"), (118, "W")]
    master = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5), ("d", None), ("e", 9)], "pdb_id string, cdr3_len_actual int")
    calls = spark.createDataFrame([("a", numbered(3)), ("b", numbered(6)), ("c", None), ("d", numbered(1))], "pdb_id string, numbering array<struct<position:int,aa:string>>")
    one, odd = audits.numbering_check(master, calls)
    assert tuple(one.first()) == (3, 2, 1, 1, 50.0) and got(odd) == [("b", 4, 6)]


def test_boundary_lengths_and_models(spark):
    log = spark.createDataFrame([("h3_too_long_42",), ("h3_too_long_40",), ("h3_too_short_2",), ("short_H",)], "stage string")
    assert got(audits.boundary_lengths(log), "direction", "n", "mean") == [("long", 2, 41.0), ("short", 1, 2.0)]
    models = spark.createDataFrame([("0", "2020"), ("x", "2019"), ("x", "2021"), ("1.5", "2018"), ("-1", "2000")], "model string, date string")
    assert got(audits.odd_models(models)) == [("1.5", 1, "2018", "2018"), ("x", 2, "2019", "2021")]
    clamped = spark.createDataFrame([("0", 3), ("7", 3), ("x", 3)], "m string, n int").select(funnel.clamp_model(F.col("m"), F.col("n")).alias("i"), funnel.over_cap(F.lit(281)).alias("over"), funnel.over_cap(F.lit(280)).alias("at"))
    assert got(clamped) == sorted([(0, True, False), (2, True, False), (None, True, False)], key=repr)


def test_terms_scope_agreement_excludes(spark):
    df = spark.createDataFrame([("SARS-CoV-2 spike", None), ("x", "Severe acute"), ("x.y", "z"), (None, None)], "a string, b string")
    hit = audits.any_term("a", ("cov-2", "x.y"), "b", ("acute",))
    assert [r[0] for r in df.select(hit).collect()] == [True, True, True, False]
    calls = spark.createDataFrame([("human", None, "K"), ("human", None, "H"), ("mouse", "mouse", "L")], "heavy_species string, light_species string, chain_type string")
    assert got(audits.chain_scope(calls)) == [("human", 2, 1)]
    flags = spark.createDataFrame([(True, True), (False, True), (True, False)], "ok boolean, sure boolean")
    r = S.agreement(flags, F.col("ok"), all=F.lit(True), sure=F.col("sure"), none=F.lit(False)).first()
    assert r["all"] == pytest.approx(2 / 3) and r["sure"] == 0.5 and r["none"] is None
    assert [r[0] for r in spark.createDataFrame([(0.0, 1.0, 0.5), (0.0, 1.0, 1.5), (0.6, 1.0, 0.5)], "l double, h double, v double").select(S.excludes(F.col("l"), F.col("h"), F.col("v"))).collect()] == [False, True, True]


def test_masks_loops_and_interfaces(spark):
    mask = [False, True, True, False, True, False, True, True, True]
    on = [False, True, False, False, False, False, True, True, False]
    rows = [("s", True, ("ABCDEFGHI",), mask, on)]
    df = spark.createDataFrame(rows, "filename_stem string, has_antigen boolean, heavy struct<sequence_aa:string>, cdr_mask array<boolean>, interface_mask array<boolean>")
    assert got(audits.zero_interface(df)) == [("1", 1, 0), ("2", 1, 1), ("3", 1, 0)]
    # letters of the alphabet only: B is none
    assert got(audits.loop_compositions(df), "loop", "scope", "letter", "n") == sorted([("1", "full", "C", 1), ("2", "full", "E", 1), ("3", "full", "G", 1), ("3", "full", "H", 1), ("3", "full", "I", 1), ("3", "masked", "G", 1), ("3", "masked", "H", 1)], key=repr)
    places = [26.0, 27.0, 104.9, 105.0, 117.0, 118.0]
    assert spark.createDataFrame([(places,)], "p array<double>").select(T.loop_mask(F.col("p"))).first()[0] == [False, True, False, True, True, False]
    points = [[float(i), 0.0, 0.0] for i in range(9)]
    pick = lambda m, p, rule: spark.createDataFrame([(m, p)], "m array<boolean>, p array<array<double>>").select(geometry.loop_points(F.col("m"), F.col("p"), rule)).first()[0]
    assert pick(mask, points, "last") == points[6:] == pick(mask, points, "third_or_last")
    assert pick([True] * 2 + [False] * 7, points, "last") is None and pick(mask, [*points[:8], [float("nan")] * 3], "last") is None
    cut = geometry.masked_composition(spark.createDataFrame([("ACA", [True, True, False]), ("A", None)], "seq string, mask array<boolean>"), audits.ALPHABET)
    assert got(cut) == [("full", "A", 2), ("full", "C", 1), ("masked", "A", 1), ("masked", "C", 1)]


def test_repertoire_composition(spark):
    tokens = [0, 5, 6, 99, 24, 5]
    df = spark.createDataFrame([(tokens, [True, False, True, True, True, True]), ([5], [False])], "tokens array<int>, cdr_full_mask array<boolean>")
    assert got(audits.repertoire_composition(df)) == [("A", 1), ("C", 1), ("Y", 1)]
    assert df.select(audits.token_letters(F.col("tokens"), audits.SYMBOLS)).first()[0] == ["A", "C", "Y", "A"]


def test_contacts(spark):
    atoms = spark.createDataFrame([("p", "1", "A", 0.0, 0.0, 0.0), ("p", "1", "A", 9.0, 0.0, 0.0), ("p", "2", "C", 20.0, 0.0, 0.0), ("q", "1", "A", 0.0, 0.0, 0.0)], "pdb_id string, residue string, aa string, x double, y double, z double")
    targets = spark.createDataFrame([("p", 14.0, 0.0, 0.0)], "pdb_id string, x double, y double, z double")
    distances = geometry.contact_distances(atoms, targets)
    assert got(distances) == [("p", "1", "A", 5.0), ("p", "2", "C", 6.0)]
    assert got(geometry.interface_mask(distances, 5.5), "residue", "interface") == [("1", True), ("2", False)]
    table, spread = audits.contact_audit(atoms, targets, spark.createDataFrame([("p", "c1")], "pdb_id string, cluster_rep string"), cut=6.0, replicates=20)
    assert got(table.where("threshold = 6.0"), "aa", "contacting", "other") == [("A", 1, 0), ("C", 1, 0)]
    assert got(table.where("threshold = 4.5"), "aa", "contacting", "other", "fold") == [("A", 0, 1, None), ("C", 0, 1, None)]
    assert {r["column"]: r["median"] for r in spread.collect() if r["median"]} == {"A": 0.5, "C": 0.5}


def test_weighting_comparison(spark):
    profile = spark.createDataFrame([("a", 8, 2), ("b", 8, 2)], "c string, x long, y long")
    rows = {r["column"]: r for r in audits.weighting_comparison(profile, "c", ["x", "y"], {"x": 0.4}, 50).collect()}
    assert rows["x"]["fold"] == pytest.approx(2) and rows["x"]["significant"] and rows["y"]["fold"] is None


def test_backbone_and_unique_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rows = [("a", "c", (base + 5).tolist()), ("b", "c", (base @ turn.T).tolist()), ("x", "big", base.tolist()), ("y", "big", base.tolist()), ("z", "big", base.tolist()), ("n", "c", None)]
    df = spark.createDataFrame([(s, c, [True] * 4, p) for s, c, p in rows], "filename_stem string, cluster string, cdr_mask array<boolean>, coords array<array<double>>")
    pairs, skipped, unequal = audits.backbone(df, "cluster", 2, 2)
    (pair,) = pairs.collect()
    assert {pair["a"], pair["b"]} == {"a", "b"} and pair["rmsd"] == pytest.approx(0, abs=1e-6) and got(skipped) == [("big", 3)]
    chains = spark.createDataFrame([("c", "1", "H", "L"), ("c", "0", "H", "L"), ("c", "2", "H", None), ("c", "3", "H", None), ("d", "4", "H", "L")], "cluster string, id string, vh string, vl string")
    assert got(geometry.unique_pairs(chains, "cluster", "id", "vh", "vl"), "cluster", "id") == [("c", "0"), ("c", "2"), ("d", "4")]


def test_germline(spark):
    good = "GCT" * 60
    nt = spark.createDataFrame([("v1", good), ("short", "GCTGCT"), ("odd", "NNN" * 60)], "gene_id string, seq string")
    fine, bad = audits.germline_reference(nt, "V")
    names = {r["gene_id"] for r in fine.collect()} | {r["gene_id"] for r in bad.collect()}
    assert names == {"v1", "short", "odd"} and {r["gene_id"] for r in bad.collect()} >= {"short"} and all(r["reason"] for r in bad.collect())
    j = spark.createDataFrame([("j1", "TGGGGCCAAGGGACCACGGTCACCGTCTCCTCAG")], "gene_id string, seq string")
    assert [r["gene_id"] for r in audits.germline_reference(j, "J")[0].collect()] == ["j1"]
    ref = spark.createDataFrame([("a", "ACDX"), ("b", "WY")], "gene_id string, seq string")
    state = lambda d, low, high: audits.reference_check(d, low, high).first()["state"]
    assert (state(ref, 1, 5), state(ref, 3, 5), state(ref.limit(0), 0, 5)) == ("OK", "OUT_OF_RANGE", "EMPTY")
    assert state(ref.unionByName(spark.createDataFrame([("c", "B1")], ref.schema)), 1, 5) == "BAD_ALPHABET"


def test_locus_cross_method_and_summary(spark):
    kinds = "k struct<gene_id:string,identity:double>, l struct<gene_id:string,identity:double>"
    df = spark.createDataFrame([(("K1", 0.9), ("L1", 0.9)), (("K1", 0.8), ("L1", 0.9)), ((None, 0.0), ("L2", 0.1)), ((None, 0.0), (None, 0.0))], kinds)
    assert [tuple(r[0])[:2] for r in df.select(align.choose_locus(F.col("k"), F.col("l"))).collect()] == [("kappa", "K1"), ("lambda", "L1"), ("lambda", "L2"), (None, None)]
    ours = spark.createDataFrame([(1, "IGHV3-23", True), (2, "IGHV3-7", True), (3, "IGHV1-2", False), (4, None, False)], "id int, gene_id string, sure boolean")
    theirs = spark.createDataFrame([(1, "IGHV3-23"), (2, "IGHV3-9"), (3, "IGHV4-1"), (4, "IGHV1-2")], "id int, gene_id string")
    r = align.cross_method(ours, theirs, "id", T.gene_family, "sure").first()
    assert (r["allele"], r["allele_confident"], r["allele_other"], r["family"], r["family_confident"]) == (0.25, 0.5, 0.0, 0.5, 1.0)
    both = [d.withColumn("species", F.when(F.col("id") == 1, x).when(F.col("id") == 2, "mouse")) for d, x in ((ours, "Human "), (theirs, "human"))]
    r = align.cross_method(*both, "id", T.gene_family, "sure", "species").first()
    assert (r["allele"], r["species"], r["species_confident"]) == (0.25, 0.5, 1.0)
    calls = spark.createDataFrame([("IGHV3-23", 0.9), ("IGHV3-7", 0.7), ("IGHV1-2", 0.8), ("IGHV2-1", 0.6), (None, 0.0)], "gene_id string, identity double")
    r = align.assignment_summary(calls, T.gene_family).first()
    assert (r["n"], r["no_match"], r["min_identity"], r["max_identity"]) == (5, 1, 0.6, 0.9) and r["mean_identity"] == pytest.approx(0.75)
    assert [tuple(x) for x in r["top_families"]] == [("IGHV3", 2), ("IGHV1", 1)]


def test_component_splits_and_partition(spark):
    rows = [(i, f"g{i // 4}", f"h{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, h string")
    done, leaks = audits.component_splits(df, "id", ["g"], ["g", "h"])
    assert done.count() == 200 and {r["n_leaked"] for r in leaks.collect()} == {0}
    assert {r["split"]: r["count"] for r in done.groupBy("split").count().collect()} == {"train": 160, "val": 20, "test": 20}


def _one_by_one(sizes, splits=graph.SPLITS):
    total = sum(n for _, n in sizes)
    room = {s: share * total for s, share in splits}
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(room, key=lambda s: room[s])
        room[best] -= n
        out[name] = best
    return out


def test_greedy_partition_equals_one_after_another(spark):
    rng = np.random.default_rng(3)
    for most, shares in ((1, graph.SPLITS), (4, graph.SPLITS), (9, (("a", 0.5), ("b", 0.25), ("c", 0.125), ("d", 0.125)))):
        sizes = [(f"k{i:04d}", int(n)) for i, n in enumerate(rng.integers(1, most + 1, 300))]
        found = graph.greedy_partition(spark.createDataFrame(sizes, "component string, n long"), shares)
        assert {r["component"]: r["split"] for r in found.collect()} == _one_by_one(sizes, shares)
    runs = graph.greedy_runs([(1, 10_000_000), (7, 3)])
    assert len(runs) < 50 and sum(high - low + 1 for _, low, high, _ in runs) == 10_000_003


def test_rounds_that_run_out_raise(spark):
    chain = spark.createDataFrame([(i, i // 2, (i + 1) // 2) for i in range(40)], "id int, a int, b int")
    with pytest.raises(RuntimeError, match="not settled"):
        graph.components(chain, "id", ["a", "b"], rounds=1)
    names = [f"{i:03d}" for i in range(300)]  # so long that one round cannot cover it, whatever the priorities
    texts = spark.createDataFrame([(c,) for c in names], "t string")
    path = spark.createDataFrame([(a, b, 1.0) for a, b in zip(names, names[1:])], "a string, b string, identity double")
    with pytest.raises(RuntimeError, match="uncovered"):
        dedup.cover(texts, path, rounds=1)


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = {"".join(rng.choice(list("ab"), int(rng.integers(1, 14)))) for _ in range(90)} | {"common prefix " + "".join(rng.choice(list("abcd"), 6)) for _ in range(40)}
    df = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,), ("",)], "t string")
    for identity in (0.7, 0.9):
        want = {(a, b) for a in texts for b in texts if a < b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 1 - _edit(a, b) / max(len(a), len(b)) >= identity - 1e-12}
        found = dedup.similar_pairs(df, "t", identity).collect()
        assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)


def test_threshold_sensitivity(spark):
    df = spark.createDataFrame([("abcdefghij", "x"), ("abcdefghij", "x"), ("abcdefghiz", "y"), ("abcdefghyz", "y"), ("qqqqqqqqqq", "z")], "t string, c string")
    found = {(r["threshold"], r["metric"]): r["value"] for r in dedup.threshold_sensitivity(df, "t", (0.8, 0.9, 0.95), 0.8, {"c": F.col("c")}).collect()}
    assert [found[t, "n_clusters"] for t in (0.8, 0.9, 0.95)] == [2.0, 2.0, 4.0] and found[0.95, "c_n_unique"] == 3.0 and found[0.8, "n_rows"] == 5.0


def test_antigen_clusters_and_sequences(spark):
    sequences = spark.createDataFrame([("a", "ACDEFGHIKL", "h"), ("b", "ACDEFGHIKL", "h"), ("c", "WWWWWWWWWW", "i")], "filename_stem string, seq string, hash string")
    samples = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "filename_stem string")
    found = {r["filename_stem"]: r["antigen_cluster_id"] for r in audits.antigen_clusters(samples, sequences).collect()}
    assert found["a"] == found["b"] != found["c"] and found["d"] is None and found["a"].startswith("cluster_rep_")
    rows = spark.createDataFrame([("a", True, "AC[MSE]"), ("b", False, "AC"), ("c", True, ""), ("d", True, None)], "filename_stem string, has_antigen boolean, antigen_seq string")
    assert got(readers.antigen_sequences(rows), "filename_stem", "seq") == [("a", "ACM")]


def test_antigen_atoms_and_parts(spark):
    atoms = spark.createDataFrame([("p", "A", "ALA"), ("p", "A", "hoh"), ("p", "a", "ALA"), ("p", "H", "GLY")], "pdb_id string, chain string, resname string")
    wanted, antibody = spark.createDataFrame([("p", "A"), ("p", "H")], "pdb_id string, chain string"), spark.createDataFrame([("p", "H")], "pdb_id string, chain string")
    assert got(readers.antigen_atoms(atoms, wanted, antibody)) == [("p", "A", "ALA")]
    parts = spark.createDataFrame([(["A", "B", "A"],), (["A", "B", "", "", None, None],)], "p array<string>")
    assert [r[0] for r in parts.select(dedup.duplicated_parts(F.col("p"))).collect()] == [True, False]


def test_residual_chart_and_focused_snapshot(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 5)], "k int, n long"), spark.createDataFrame([(1, 1), (3, 3)], "k int, n long")
    rows, top = audits.chart_residuals(a, b, "k")
    assert rows.count() == 3 and top.first()["k"] == 3 and top.first()["largest"] == pytest.approx(0.75)
    df = spark.createDataFrame([("c1", "viral"), ("c1", "viral"), ("c2", "other"), ("c3", None)], "cluster string, cls string")
    found = {r["metric"]: r["value"] for r in compare.focused_snapshot(df, "cluster", "cls", "viral", 1).collect()}
    assert found["cluster_top1_share"] == 0.5 and found["viral_fraction"] == pytest.approx(2 / 3) and found["cluster_n_unique"] == 3.0


def test_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    assert readers.load_config(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]}
    (tmp_path / "clusters.tsv").write_text("r1\tm1\nr1\tm2\nr2\tm1\n")
    assert {r["member"] for r in readers.read_clusters(spark, str(tmp_path / "clusters.tsv")).collect()} == {"m1", "m2"}
    for form in ("parquet", "json"):
        sinks.write_table(spark.range(3), str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 3
    log = sinks.append_log(spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("b",)], "k string"))
    assert got(log) == sorted([("a", 1), ("b", None)], key=repr)
    assert spark.createDataFrame([("ABC", [True, True, False])], "t string, m array<boolean>").select(R.masked_letters(F.col("t"), F.col("m"), "AB")).first()[0] == ["A", "B"]


def test_samples_with_missing_fields_are_counted(spark, tmp_path):
    row = "SELECT '{}' AS pdb_id, true AS paired, {} AS heavy, array(true) AS cdr_mask, array(true) AS coord_mask, false AS has_antigen, '{}' AS filename_stem"
    heavy = "named_struct('sequence_aa', 'ACD')"
    path = str(tmp_path / "samples")
    spark.sql(" UNION ALL ".join([row.format("1abc", heavy, "1abc_H"), row.format("2abc", "CAST(NULL AS struct<sequence_aa:string>)", "2abc_H"), row.format("3abc", heavy, "3abc_H")])).write.parquet(path)
    found = readers.read_samples(spark, path)
    assert {r["pdb_id"]: r["schema_error"] for r in found.collect()} == {"1abc": None, "2abc": "missing heavy", "3abc": None}
    assert readers.load_counts(found).first().asDict() == {"scanned": 3, "schema_errors": 1}


def test_tier_report(spark):
    import math

    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        tier = [None, "100", "99", "x"][i % 4]
        species = ["human", "mouse", None][i % 3] if i % 50 else None
        length = None if i == 7 else math.nan if i == 11 else float(15 + rng.integers(0, 6) - 2 * (tier == "100") + (species == "mouse"))
        rows.append((tier, tier is not None, f"n{i % 9}" if i % 20 else None, f"H{i % 30}" if i % 31 else None, None, f"p{i % 40}", f"c{i % 80}", length, species, i % 5 == 0))
    df = spark.createDataFrame(rows, "tier string, is_therapeutic boolean, therapeutic string, h string, l string, pdb string, chain string, y double, species string, light boolean")
    given = (["h", "l"], "therapeutic", ["pdb", "chain"], "y", {"species": F.col("species"), "light": F.col("light")})
    got = {(r["section"], r["item"], r["metric"]): r["value"] for r in audits.tier_report(df, ("100", "99", "95-98"), *given, replicates=400).collect()}
    for item, keep in {"100": lambda r: r[0] == "100", "99": lambda r: r[0] == "99", "95-98": lambda r: False, "any": lambda r: r[1], "all": lambda r: True}.items():
        kept = [r for r in rows if keep(r)]
        assert got["counts", item, "n_rows"] == len(kept) and got["counts", item, "n_unique"] == len({r[3:5] for r in kept})
        assert got["counts", item, "percent_of_rows"] == pytest.approx(len(kept) / 4)
    names, chains = {}, {}
    for r in rows:
        if r[1]:
            chains.setdefault(r[5:7], set()).add(r[2])
            if r[2]:
                names.setdefault(r[2], set()).add(r[5])
    assert got["mapping", "names", "names"] == len(names) and got["mapping", "names", "most"] == max(map(len, names.values()))
    assert got["mapping", "names", "names_of_several"] == sum(len(v) > 1 for v in names.values())
    assert got["mapping", "structures", "structures_of_several"] == sum(len(v - {None}) > 1 for v in chains.values())
    measured = [r for r in rows if r[7] is not None and not math.isnan(r[7])]
    a, b = ([r[7] for r in measured if (r[0] == "100") is x] for x in (True, False))
    length = {m: v for (s, _, m), v in got.items() if s == "length"}
    assert length["difference"] == pytest.approx(np.mean(a) - np.mean(b)) and length["mean"] == pytest.approx(np.mean(a))
    error = np.sqrt(np.var(a) / len(a) + np.var(b) / len(b))
    assert length["low"] < length["difference"] < length["high"] and 0.8 < (length["high"] - length["low"]) / (2 * 1.96 * error) < 1.2
    full = [r for r in measured if r[8] is not None]
    x = np.array([[1, r[0] == "100", r[8] == "mouse", r[9]] for r in full], float)
    assert length["adjusted"] == pytest.approx(np.linalg.lstsq(x, np.array([r[7] for r in full]), rcond=None)[0][1]) and length["adjusted_rows"] == len(full)


def test_tier_report_of_nothing(spark):
    df = spark.createDataFrame([], "tier string, is_therapeutic boolean, therapeutic string, h string, pdb string, y double")
    got = {(r["item"], r["metric"]): r["value"] for r in audits.tier_report(df, ("100",), ["h"], "therapeutic", ["pdb"], "y", {}, replicates=8).collect()}
    assert got["100", "n_rows"] == 0 and got["all", "percent_of_rows"] is None and got["names", "most"] == 0 and got["100", "difference"] is None and got["100", "adjusted"] is None


def test_pair_rmsd_of_rotated_copies_and_null_points(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=(5, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rows = [("a", 1, one.tolist()), ("a", 2, (one @ turn + 7).tolist()), ("a", 3, (one * [1, 1, -1]).tolist()), ("a", 4, [*one.tolist()[:4], None]), ("a", 5, one.tolist()[:2]), ("a", 6, None), (None, 7, one.tolist()), (None, 8, one.tolist())]
    df = spark.createDataFrame(rows, "c string, k int, p array<array<double>>")
    found = {(r["a"], r["b"]): r["rmsd"] for r in geometry.pair_rmsd(df, "c", "k", "p").collect()}
    assert found.keys() == {(1, 2), (1, 3), (2, 3)} and found[1, 2] < 1e-6 < 0.01 < found[1, 3]
    assert found[1, 3] == pytest.approx(found[2, 3]) and geometry.pair_rmsd(df.limit(0), "c", "k", "p").count() == 0
