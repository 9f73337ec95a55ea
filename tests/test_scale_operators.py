"""Operators that replace all-pairs or one-task work, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import ranks
from ledgerlens.functions import stats as S
from ledgerlens.functions import text as T
from ledgerlens.operators import align, dedup, edits, geometry, graph
from ledgerlens.plans import catalogue, catalogue_rows  # noqa: F401  (the latter adds to the former)


def brute_pairs(texts, identity, coverage=0.8):
    con = duckdb.connect()
    con.register("w", pd.DataFrame({"t": sorted(set(texts) - {None, ""})}))
    rows = con.execute(
        "SELECT x.t, y.t, 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) FROM w x JOIN w y ON x.t < y.t "
        f"AND least(length(x.t), length(y.t)) >= {coverage} * greatest(length(x.t), length(y.t)) - 1e-9 AND levenshtein(x.t, y.t) <= {1 - identity} * greatest(length(x.t), length(y.t)) + 1e-9"
    ).fetchall()
    return {(a, b): i for a, b, i in rows}


def mutated(rng, text, edits, letters):
    text = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.random()
        if kind < 0.4:
            text.insert(at, rng.choice(letters))
        elif text and at < len(text):
            if kind < 0.7:
                text[at] = rng.choice(letters)
            else:
                del text[at]
    return "".join(text)


@pytest.mark.parametrize("identity", [0.5, 0.7, 0.75, 0.85, 0.95])
def test_similar_pairs_of_all_lengths(spark, identity):
    rng = random.Random(int(identity * 100))
    texts = []
    for length, letters in ((1, "ab"), (3, "abc"), (9, "abcd"), (24, "ACDEFGHIKL"), (60, "ACDEFGHIKLMNPQRSTVWY"), (130, "ACGT")):
        for _ in range(6):
            base = "".join(rng.choice(letters) for _ in range(length))
            texts += [base, *(mutated(rng, base, rng.randint(0, max(1, int(0.4 * length))), letters) for _ in range(6))]
    texts += ["aaaaaaaaaaaa", "aaaaaaaaaaaaaaa", "abababababab", None, "", texts[5]]
    want = brute_pairs(texts, identity)
    found = dedup.similar_pairs(spark.createDataFrame([(t, 1, 2) for t in texts], "t string, id int, n int"), "t", identity).collect()
    assert {(r["a"], r["b"]) for r in found} == set(want) and len(found) == len(want)
    assert all(abs(r["identity"] - want[r["a"], r["b"]]) < 1e-12 for r in found)


def test_letters_are_code_points(spark):
    found = dedup.similar_pairs(spark.createDataFrame([("é\U0001f600" * 6,), ("é\U0001f600" * 7,), ("e\U0001f600" * 6,)], "t string"), "t", 0.85).collect()
    assert [(len(r["a"]), len(r["b"]), round(r["identity"], 9)) for r in found] == [(12, 14, round(12 / 14, 9))]


def test_blocks_are_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 7)
    monkeypatch.setattr(dedup, "PROBES", 0)
    rng = random.Random(2)
    base = ["".join(rng.choice("ACDE") for _ in range(12)) for _ in range(8)]
    texts = [*base, *(mutated(rng, b, 3, "ACDE") for b in base for _ in range(8))]
    found = dedup.similar_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 0.7)
    assert {(r["a"], r["b"]) for r in found.collect()} == set(brute_pairs(texts, 0.7))


def test_segments_meet_few_texts(spark):
    """Of random texts nearly none is a candidate, where lengths alone would make all of them one."""
    rng = random.Random(3)
    words = spark.createDataFrame([(i, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)), 30) for i in range(1500)], "id long, t string, n int")
    met = dedup.segment_pairs(words, words, 0.8, 0.8).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().count()
    assert met < 0.02 * 1500 * 1499 / 2


@pytest.mark.parametrize("tiles", [False, True])
@pytest.mark.parametrize("identity", [0.5, 0.8, 0.95])
def test_tiles_and_candidates_find_the_same_pairs(spark, monkeypatch, identity, tiles):
    """Texts of one word of bits, of several, and beyond the letters compared in tiles."""
    monkeypatch.setattr(edits, "LETTERS", 100)
    rng = random.Random(7)
    texts = []
    for length, letters in ((6, "ab"), (40, "abcd"), (64, "ab"), (90, "ACGT"), (99, "ab"), (110, "ACGT")):
        base = "".join(rng.choice(letters) for _ in range(length))
        texts += [base, *(mutated(rng, base, rng.randint(0, max(1, int(0.3 * length))), letters) for _ in range(12))]
    want = brute_pairs(texts, identity)
    found = dedup.similar_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), "t", identity, tiles=tiles).collect()
    assert {(r["a"], r["b"]): round(r["identity"], 9) for r in found} == {p: round(x, 9) for p, x in want.items()} and len(found) == len(want)


def crowd(rng, many):
    """Urls of few hosts, most of which share most grams."""
    hosts = ["https://blog.tionsh.example.com", "http://blog.thther.example.net", "https://www.ththre.example.net"]
    return sorted({f"{rng.choice(hosts)}/{rng.choice(['en', 'fr'])}/{rng.randint(1, 9999)}{rng.choice(['', '#top', '?page=2&ref=x'])}" for _ in range(many)})


def test_a_crowd_shuffles_no_candidates(spark, monkeypatch):
    """Where most texts share grams, no pair goes through a shuffle unless it is a result."""
    rng = random.Random(8)
    texts = crowd(rng, 300)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    random_texts = spark.createDataFrame([("".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)), 30) for _ in range(1500)], "t string, n int")
    assert dedup.crowded(df.withColumn("n", F.length("t")), 0.8, 0.8) and not dedup.crowded(random_texts, 0.8, 0.8)
    for name in ("gram_pairs", "segment_pairs", "block_pairs"):
        monkeypatch.setattr(dedup, name, None)
    found = {(r["a"], r["b"]) for r in dedup.similar_pairs(df, "t", 0.8).collect()}
    assert found == set(brute_pairs(texts, 0.8))


@pytest.mark.parametrize("links", [0, 4000])
def test_a_crowd_is_covered_as_its_pairs_would_be(spark, monkeypatch, links):
    """Without writing pairs, or with pairs once few are left; the representatives are the same."""
    texts = [*crowd(random.Random(9), 150), "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = dedup.similar_pairs(df, "t", 0.8, tiles=False)
    want = {r["t"]: r["rep"] for r in dedup.cover(df.where("t IS NOT NULL"), pairs).collect()}
    monkeypatch.setattr(dedup, "LINKS", links)
    found = {r["t"]: r["cluster_rep"] for r in dedup.near_clusters(df, "t", 0.8, tiles=True).collect()}
    assert found.pop(None) is None and found == want


def test_representatives_are_apart_and_cover_all(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDEFG") for _ in range(18)) for _ in range(12)]
    texts = [*base, *(mutated(rng, b, rng.randint(1, 4), "ACDEFG") for b in base for _ in range(12))]
    near = brute_pairs(texts, 0.8)
    near = {*near, *((b, a) for a, b in near)}
    rows = dedup.near_clusters(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 0.8).collect()
    rep = {r["t"]: r["cluster_rep"] for r in rows}
    reps = set(rep.values())
    assert rep.keys() == set(texts) and all(t == r or (t, r) in near for t, r in rep.items()) and all(rep[r] == r for r in reps)
    assert not any((a, b) in near for a in reps for b in reps)


def test_a_long_chain_is_covered_in_few_rounds(spark):
    names = [f"{i:05d}" for i in range(20_000)]
    texts = spark.createDataFrame([(n,) for n in names], "t string")
    path = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    rows = dict(map(tuple, dedup.cover(texts, path, rounds=40).select("t", "rep").collect()))
    heads = [int(t) for t, r in rows.items() if t == r]
    assert len(rows) == 20_000 and all(abs(int(t) - int(r)) <= 1 for t, r in rows.items()) and min(np.diff(sorted(heads))) > 1


# ---- ranks


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": [f"k{i}" for i in range(900)], "n": rng.integers(1, 5, 900), "m": rng.integers(0, 9, 900)})
    df = spark.createDataFrame(frame).repartition(7)
    got = ranks.running(df, ["n", "g"], total="n", other="m").toPandas().sort_values("rank").reset_index(drop=True)
    want = frame.sort_values(["n", "g"]).reset_index(drop=True)
    assert got["g"].tolist() == want["g"].tolist() and got["rank"].tolist() == list(range(1, 901))
    assert got["total"].tolist() == want["n"].cumsum().tolist() and got["other"].tolist() == want["m"].cumsum().tolist()
    assert ranks.running(df.limit(0), ["n", "g"], total="n").count() == 0
    points = M.lorenz(df.select("g", "n"), "g")
    assert abs(M.trapezoid_gini(points).first()[0] - M.summary(df.select("g", "n")).first()["gini"]) < 1e-9


def test_quantiles_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 20)
    monkeypatch.setattr(ranks, "BINS", 64)
    rng = np.random.default_rng(2)
    inf, nan = math.inf, math.nan
    groups = {
        "normal": rng.normal(size=700).tolist(),
        "wide": (10.0 ** rng.uniform(-300, 300, 400)).tolist() + [-1e308, 1e308, 5e-324, 0.0, -0.0],
        "ties": [1.0] * 500 + [2.0] * 3 + [-7.5] * 40,
        "odd": [inf, -inf, nan, nan, 1.0, 2.0, None] + [nan] * 30 + [inf] * 30,
        "one": [3.5],
        None: [float(i) for i in range(101)],
        "none": [None, None],
    }
    rows = [(g, i % 2, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, k0 int, n double").repartition(5)
    p = [0.0, 0.025, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in ranks.quantiles(df, "n", p, "g").collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("n", F.array(*map(F.lit, p))).alias("q")).where("g IS NULL OR g <> 'none'").collect()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        assert r["n"] == sum(v is not None for v in groups[g])
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(r["q"], want[g])), g
    whole = ranks.quantiles(df, "n", p).first()
    assert whole["q"][:4] == df.agg(F.percentile("n", F.array(*map(F.lit, p))).alias("q")).first()["q"][:4]
    two = ranks.quantiles(df, "n", [0.5], "g", "k0").count()
    assert two == df.where("n IS NOT NULL").select("g", "k0").distinct().count()
    assert ranks.quantiles(df.limit(0), "n", p, "g").count() == 0
    assert [(r["n"], r["q"]) for r in ranks.quantiles(df.limit(0), "n", p).collect()] == [(0, [None] * 5)]
    with pytest.raises(RuntimeError, match="not settled"):
        ranks.quantiles(df, "n", p, "g", rounds=1)


def test_quantiles_of_one_large_column(spark):
    df = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    got = ranks.quantiles(df, "v", [0.025, 0.5, 0.975]).first()
    assert got["n"] == 300_000 and got["q"] == df.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")).first()["q"]


def test_describe_of_groups_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, x double")
    got = {r["g"]: (r["n"], r["median"], r["below_2"]) for r in M.describe(df, "x", "g", below=(2.0,)).collect()}
    assert got == {"a": (2, 2.0, 0.5), None: (1, 5.0, 0.0), "b": (0, None, None)}
    empty = M.describe(df.limit(0), "x").collect()
    assert len(empty) == 1 and empty[0]["n"] == 0 and empty[0]["median"] is None


# ---- bootstraps


def test_poisson_weights_and_sums(spark):
    chance = [math.exp(-1) / math.factorial(k) for k in range(8)]
    assert list(S.POISSON) == [math.floor(65536 * sum(chance[: k + 1])) for k in range(8)]
    units = [(f"u{i}", float(i % 7), i % 3) for i in range(40)] + [(None, 2.0, None)]
    got = {r["replicate"]: (r["a"], r["b"]) for r in S.poisson_sums(spark.createDataFrame(units, "u string, a double, b int"), "u", ["a", "b"], 19, 5).collect()}
    for r in range(19):
        want = np.zeros(2)
        for u, a, b in units:
            digest = hashlib.md5(f"5:{u or ''}:{r // 8}".encode()).hexdigest()
            drawn = int(digest[4 * (r % 8) : 4 * (r % 8) + 4], 16)
            want += sum(drawn >= t for t in S.POISSON) * np.array([a, b or 0])
        assert got[r] == tuple(want)
    many = S.poisson_sums(spark.range(3000).selectExpr("id", "1 AS one"), "id", ["one"], 64).toPandas()["one"] / 3000
    assert abs(many.mean() - 1) < 0.01 and abs(many.std() * math.sqrt(3000) - 1) < 0.25


# ---- contacts


def brute_contacts(atoms, targets):
    out = {}
    for s, r, aa, *p in atoms:
        for t, *q in targets:
            if s == t and None not in (s, *p, *q) and np.isfinite([*p, *q]).all():
                out[s, r, aa] = min(out.get((s, r, aa), math.inf), math.dist(p, q))
    return out


def test_contacts_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    atoms = [("hot", i // 3, "ACD"[i // 3 % 3], *map(float, rng.normal(size=3) * 40)) for i in range(600)]
    atoms += [("far", i, "A", 1e4 * i + 3.0, -7.0, 1e6 * (i % 2)) for i in range(12)] + [("s", 1, "A", 0.0, 0.0, 0.0), ("s", 2, "C", -10.0, 0.0, 0.0), ("s", None, "C", 9.0, 0.0, 0.0), ("no targets", 1, "A", 0.0, 0.0, 0.0)]
    atoms += [("s", 3, "A", math.nan, 0.0, 0.0), ("s", 4, "A", None, 0.0, 0.0), ("s", 5, "A", math.inf, 0.0, 0.0), (None, 1, "A", 0.0, 0.0, 0.0)]
    targets = [("hot", *map(float, rng.normal(size=3) * 40)) for _ in range(400)] + [("far", 0.0, 0.0, 0.0), ("far", 6e4, 1.0, 0.0), ("s", 10.0, 0.0, 0.0), ("s", math.nan, 0.0, 0.0), ("only targets", 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    a = spark.createDataFrame(atoms, "pdb_id string, residue int, aa string, x double, y double, z double")
    t = spark.createDataFrame(targets, "pdb_id string, x double, y double, z double")
    want = brute_contacts(atoms, targets)
    for cell in (2.0, 10.0, 500.0):
        got = {tuple(r[:3]): r["min_dist"] for r in geometry.contact_distances(a, t, cell=cell).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)
    for cut in (4.5, 10.0, 20.0):
        rows = geometry.contacts_within(a, t, cut).collect()
        assert {tuple(r[:3]): round(r["min_dist"], 9) for r in rows} == {k: round(d, 9) for k, d in want.items() if d <= cut}
    for empty in ((a.limit(0), t), (a, t.limit(0))):
        assert geometry.contact_distances(*empty).count() == 0 and geometry.contacts_within(*empty, 5.0).count() == 0
    # pairs follow the cut-off
    pairs = geometry._cells(a.where("pdb_id = 'hot'"), 5.0, around=True).join(geometry._cells(t.where("pdb_id = 'hot'"), 5.0).select("pdb_id", "_ix", "_iy", "_iz"), ["pdb_id", "_ix", "_iy", "_iz"]).count()
    assert pairs < 0.05 * 600 * 400


# ---- alignment


def brute_best(query, refs, coverage):
    top = (0.0, None, 0, 0.0)
    for g, r in sorted(refs):
        if r:
            _, matches, pairs = align.local_alignment(query, r)
            if pairs and pairs / len(r) >= coverage and matches / pairs > top[0]:
                top = (matches / pairs, g, pairs, pairs / len(r))
    return top[1], top[0], top[2], top[3]


def germline(rng, families=12, size=5, length=60):
    letters, out = "ACDEFGHIKLMNPQRSTVWY", []
    for f in range(families):
        base = "".join(rng.choice(letters) for _ in range(length))
        out += [(f"IGHV{f}-{m}", "".join(rng.choice(letters) if rng.random() < 0.06 else c for c in base)) for m in range(size)]
    return out


def test_best_matches_equal_all_pairs_with_few_alignments(spark):
    rng = random.Random(8)
    refs = germline(rng) + [("dup", ""), ("none", None)]
    refs.append(("IGHV0-0b", refs[0][1]))  # a tie
    letters = "ACDEFGHIKLMNPQRSTVWY"
    queries = [mutated(rng, rng.choice(refs[:60])[1], rng.randint(0, 25), letters) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    queries += ["".join(rng.choice(letters) for _ in range(70)) for _ in range(6)] + ["AC", "", None, refs[0][1], refs[0][1].lower(), "BZX*-"]
    rows = [(i, q, "x") for i, q in enumerate(queries)]
    for coverage in (0.8, 0.3):
        got = {r["id"]: r for r in align.best_matches(spark.createDataFrame(rows, "id int, seq string, gene_id string"), spark.createDataFrame(refs, "gene_id string, seq string"), coverage=coverage).collect()}
        held = align.References([g for g, r in refs if r], [r for _, r in refs if r], coverage)
        for i, q in enumerate(queries):
            want = brute_best(q or "", refs, coverage)
            assert (got[i]["gene_id"], got[i]["identity"], got[i]["aligned"], got[i]["coverage"]) == want == held.best(q or "")
        if coverage == 0.8:
            assert held.tried < 0.25 * len(queries) * 61
    none = align.best_matches(spark.createDataFrame(rows[:2], "id int, seq string, x string"), spark.createDataFrame([], "gene_id string, seq string")).collect()
    assert [r["gene_id"] for r in none] == [None, None]


def test_assignment_of_chains_in_one_call(spark):
    rng = random.Random(9)
    refs, loci = [], {}
    for s in ("Homo sapiens", "Mus musculus"):
        for locus in ("IGH", "IGK", "IGL"):
            for segment, length in (("V", 50), ("J", 15)):
                for i in range(3):
                    seq = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(length))
                    refs.append((s, locus, segment, f"{locus}{segment}{i}-1", seq))
                    loci[s.lower(), locus, segment, i] = seq
    light = lambda s, locus: loci[s, locus, "V", 1] + "GGG" + loci[s, locus, "J", 2]
    human, mouse = "homo sapiens", "mus musculus"
    chains = [
        ("a", " Homo sapiens ", "homo sapiens", loci[human, "IGH", "V", 2] + loci[human, "IGH", "J", 0], light(human, "IGL")),
        ("b", "mus musculus", "mus musculus", loci[mouse, "IGH", "V", 0], light(mouse, "IGK")),
        ("c", "homo sapiens", "homo sapiens", "ACDEF", "W" * 40),
        ("d", "other", None, "A" * 40, "A" * 40),
        ("e", None, "homo sapiens", None, None),
    ]
    calls, counts = align.assign_chains(spark.createDataFrame(chains, "filename_stem string, heavy_species string, light_species string, heavy string, light string"), spark.createDataFrame(refs, "species string, locus string, segment string, gene_id string, seq string"), T.gene_family)
    got = {r["filename_stem"]: r for r in calls.collect()}
    assert len(got) == 5 and counts.first().asDict() == {"n_processed": 3, "n_skipped_species": 3, "n_skipped_no_sequence": 2}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["heavy"]["locus"], a["heavy"]["v_gene"], a["heavy"]["v_identity"], a["heavy"]["j_gene"], a["heavy"]["v_family"]) == ("IGH", "IGHV2-1", 1.0, "IGHJ0-1", "IGHV2")
    assert (a["light"]["locus"], a["light"]["v_gene"], a["light"]["j_gene"], a["light"]["note"]) == ("IGL", "IGLV1-1", "IGLJ2-1", None)
    assert (b["light"]["locus"], b["light"]["v_gene"], b["heavy"]["v_family"], b["heavy"]["v_coverage"]) == ("IGK", "IGKV1-1", None, 1.0)
    assert c["heavy"] is None and (c["light"]["locus"], c["light"]["v_gene"], c["light"]["v_identity"]) == (None, None, 0.0) and "neither" in c["light"]["note"]
    assert got["d"]["heavy"] is None and got["d"]["light"] is None and got["e"]["light"] is None


@pytest.mark.parametrize("query", ["components_cut", "largest_component", "connected_components"])
def test_rows_of_components_are_not_broadcast(spark, query, monkeypatch):
    """Sizes of compressed files would let the planner send all rows through the driver."""
    plans, written = [], graph.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df)

    monkeypatch.setattr(graph, "checkpointed", seen)
    found = catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if re.search(r"\bJoin (Inner|LeftOuter|LeftSemi)", line)]
    assert joins and not [x for x in joins if "strategy=" not in x]
    assert all("broadcast" not in x for x in joins if re.search(r"\(k#\d+L? = k#|p_partkey#\d+L? = p_partkey#|\(m#\d+L? = m#", x))


def test_components_with_values_of_most_rows(spark):
    """A value of more than a thousandth of the edges is joined apart from the rest."""
    rows = [(i, 0 if i % 3 else i, i // 2 + 10_000) for i in range(1, 4001)]
    df = spark.createDataFrame(rows, "id long, a int, b int")
    found = {r["id"]: r["component"] for r in graph.components(df, "id", ["a", "b"]).collect()}
    links = {i: {j for j in (i ^ 1, i) if 1 <= j <= 4000} for i, *_ in rows}
    want = {i: 1 if any(j % 3 for j in links[i]) else min(links[i]) for i in links}
    assert found == want


def test_small_structures_meet_without_cells(spark, monkeypatch):
    """Only structures of many points are cut in cells, which send 27 rows for each atom; both ways agree."""
    rng = np.random.default_rng(8)
    atoms = [("large" if i % 3 else "small", i, "A", *map(float, rng.normal(size=3) * 9)) for i in range(300)]
    targets = [("large" if i % 5 else "small", *map(float, rng.normal(size=3) * 9)) for i in range(200)]
    a = spark.createDataFrame(atoms, "pdb_id string, residue int, aa string, x double, y double, z double")
    t = spark.createDataFrame(targets, "pdb_id string, x double, y double, z double")
    for found in (geometry.contact_distances(a, t), geometry.contacts_within(a, t, 4.5)):
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(geometry, "SMALL", 200)
    assert geometry.contacts_within(a, t, 4.5)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    want = brute_contacts(atoms, targets)
    got = {tuple(r[:3]): r["min_dist"] for r in geometry.contact_distances(a, t, cell=2.0).collect()}
    near = {tuple(r[:3]): r["min_dist"] for r in geometry.contacts_within(a, t, 4.5).collect()}
    assert got == pytest.approx(want) and near == pytest.approx({k: d for k, d in want.items() if d <= 4.5})


def test_tiles_of_rmsds_equal_the_decomposition(spark, monkeypatch):
    """Pairs are made in the kernel, not joined; mirror images, lines, planes and equal sets keep their digits."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6, 3))
    base[5:10, :, 1:] = 0
    base[10:15, :, 2] = 0
    base[15:20] = base[20:25] * [1, 1, -1]
    base[25] = base[26]
    df = spark.createDataFrame([("c", i, p.tolist()) for i, p in enumerate(base)], "c string, k long, p array<array<double>>")
    monkeypatch.setattr(geometry, "STEP", 50)
    monkeypatch.setattr(geometry, "SENT", 70)
    found = geometry.pair_rmsd(df, "c", "k", "p", tile=16)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): r["rmsd"] for r in found.collect()}
    a, b = np.triu_indices(40, 1)
    want = dict(zip(zip(a.tolist(), b.tolist()), geometry.kabsch_rmsd(base[a], base[b]).tolist()))
    assert got == pytest.approx(want, abs=1e-6)


def test_a_report_without_quantiles_writes_no_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "checkpointed", lambda df: written.append(df) or df)
    assert catalogue.QUERIES["backbone_report"](spark, "/root/testdata/sf0.001").columns == ["n", "mean", "max", "below_1", "below_2"]
    assert not written
