from __future__ import annotations

import random
import re

import pytest

from ledgerlens.llm import jaccard
from ledgerlens.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    bases, out = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not bases:
            base = [rng.choice(words) for _ in range(rng.choice([3, 20, 80, 300, 700]))]
            if rng.random() < 0.4:
                base += passage
            bases.append(base)
            out.append(base)
        elif kind < 0.5:
            out.append(list(rng.choice(bases)))
        else:
            copy = list(rng.choice(bases))
            for _ in range(max(1, int(len(copy) * rng.choice([0.002, 0.01, 0.02, 0.04])))):
                copy[rng.randrange(len(copy))] = rng.choice(words) + "x"
            if rng.random() < 0.3:
                bases.append(copy)
            out.append(copy)
    return [(i * 7 % (7 * n + 1), (" " if i % 3 else "\n\t").join(w if i % 5 else w.upper() for w in ws)) for i, ws in enumerate(out)]


@pytest.mark.parametrize(("k", "num", "den", "group"), [(4, 85, 100, 256), (5, 4, 5, 256), (4, 85, 100, 3)])
def test_against_brute_force(spark, scratch, monkeypatch, k, num, den, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = corpus(k, 260)
    rows += [(100_000 + i, "one group of many copies with a few words more " * 3 + f"tail{i // 3} end") for i in range(90)]
    rows += [(200_000, None), (200_001, ""), (200_002, " \n"), (200_003, "word"), (200_004, "WORD"), (200_005, "é a"), (200_006, "É a")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df.repartition(5), scratch, k=k, threshold=(num, den)).collect()}
    assert got == brute(rows, k, num, den)


def test_hot_tokens_lose_no_link(spark, scratch, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "hot_buckets", lambda texts, k: np.full((1 << jaccard.SKETCH_BITS) // 8, 255, np.uint8))
    rows = corpus(9, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df, scratch, k=4, threshold=(85, 100)).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_empty_table_and_repeated_rows(spark, scratch):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar_documents(df, scratch, k=4).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard.similar_documents(df.limit(0), scratch).count() == 0


def test_components_of_chains_and_stars(spark, scratch):
    rng = random.Random(1)
    names = list(range(500))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(200)] + [(names[300], names[i]) for i in range(301, 480)] + [(names[490], names[490])]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    chain, star = min(names[:201]), min(names[300:480])
    assert all(found[names[i]] == chain for i in range(201)) and all(found[names[i]] == star for i in range(300, 480))


def test_one_of_each(spark, scratch):
    base = " ".join(f"w{i}" for i in range(80))
    texts = {1: base, 2: base + " more", 3: "quite another text of some words", 4: base, 9: None}
    rows = [(i, t, 7, "x") for i, t in texts.items()] + [(3, texts[3], 7, "x"), (5, "five has one text here", 7, "x"), (5, "five has another text there", 7, "x"), (None, "no id " + base[:60], 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, d string")
    found = scratch.write(jaccard.similar_documents(df, scratch), "found")
    got = sorted(map(tuple, jaccard.one_of_each(df, found).collect()), key=repr)
    assert got == sorted({r for r in rows if r[0] not in (2, 4)}, key=repr)
    assert jaccard.one_of_each(df.limit(0), found.limit(0)).count() == 0
    plan = jaccard.one_of_each(df, found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 1
