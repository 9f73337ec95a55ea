from __future__ import annotations

import collections
import datetime as dt
import gzip
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ann, decontam, kernels, license, packing, quality, warc
from ledgerlens.llm.components import components

# ---- kernels


def test_words_and_shingles():
    texts = [None, "", " a  B\tc ", "Hello, World\n\x0bx", "é É", "a" * 9000 + " b", "x"]
    want = [[], [], ["a", "b", "c"], ["hello,", "world", "x"], ["é", "É"], ["a" * 9000, "b"], ["x"]]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        got = []
        for w in kernels.words(column, size=10):
            got += [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.stop[a:b])] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        assert got == want
    many = [f"w{i}" for i in range(20000)] + ["a" * i for i in range(1, 9000, 100)]
    hashes = np.concatenate([w.hash for w in kernels.words(pa.array(many))])
    assert len(np.unique(hashes)) == len(many)


# ---- revisits


def records(spark, rows):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    return spark.createDataFrame([(i, k, u, None if s is None else at(s), h) for i, k, u, s, h in rows], "record_id long, kind string, url string, captured_at timestamp, headers map<string,string>")


def test_revisits(spark):
    day = 86_400
    rows = [
        (1, "response", "http://A.com/x/?utm_source=1#f", 0, {"etag": '"1"', "content-type": "a", "date": "d1"}),
        (2, "response", "https://a.com:443/x", 10, {"etag": '"2"', "content-type": "b", "x-keep": "k"}),
        (3, "revisit", "http://a.com/x", 9 * day, {"etag": 'W/"2"', "content-type": "ignored", "date": "d3"}),
        (4, "revisit", "http://a.com/x", 5, {"etag": '"2"'}),
        (5, "revisit", "http://a.com/x", -5, {"etag": '"1"'}),
        (6, "revisit", "http://a.com/x", 11, None),
        (7, "response", "http://b.com/", 3, {"last-modified": "m"}),
        (8, "revisit", "http://b.com", 4 * day, {"last-modified": "m"}),
        (9, "revisit", "http://b.com", 3, {"last-modified": "n"}),
        (10, "revisit", None, 3, {"etag": "x"}),
        (11, "response", "not a url", 1, None),
        (12, "revisit", "not a url", 2, {"etag": "x"}),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert {i: (r["outcome"], r["refers_to"]) for i, r in got.items()} == {
        1: ("response", 1), 2: ("response", 2), 3: ("resolved", 2), 4: ("mismatch", None), 5: ("no_response", None), 6: ("no_validator", None),
        7: ("response", 7), 8: ("resolved", 7), 9: ("mismatch", None), 10: ("no_response", None), 11: ("response", 11), 12: ("no_validator", None),
    }
    assert got[3]["merged_headers"] == {"etag": 'W/"2"', "content-type": "b", "x-keep": "k", "date": "d3"}
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_warc_files(spark, tmp_path):
    def record(kind, body):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: 2024-01-0{1 if kind == 'response' else 2}T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    data = record("warcinfo", b"x") + record("response", b'HTTP/1.1 200 OK\r\nETag: "q"\r\n\r\nhello') + record("revisit", b'HTTP/1.1 304 Not Modified\r\nETag: "q"\r\n\r\n')
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}")
    full = warc.attach_payload(warc.resolve_revisits(rows.drop("payload")), rows).collect()
    assert [(r["kind"], r["outcome"], bytes(r["payload"])) for r in sorted(full, key=lambda r: r["kind"])] == [("response", "response", b"hello"), ("revisit", "resolved", b"hello")]


# ---- nearest neighbours


def test_neighbours(spark, scratch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:160] = x[7]  # copies
    rows = [(i * 5, v.tolist(), "clash") for i, v in enumerate(x)] + [(1, None, ""), (2, [0.0] * 24, ""), (3, [float("nan")] * 24, ""), (4, [1.0, None] + [0.0] * 22, ""), (6, [float("inf")] + [1.0] * 23, ""), (8, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, scratch, block=64).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i * 5 for i in range(1500) if i * 5 % 50 == 0}
    for q, near in by.items():
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in near}
        assert [(-r["score"], r["vec_id"]) for r in near] == sorted((-r["score"], r["vec_id"]) for r in near)
        score = np.round(u @ u[q // 5], 12)
        score[q // 5] = -9
        best = set((5 * np.lexsort((np.arange(1500), -score))[:5]).tolist())
        hits, total = hits + len(best & {r["vec_id"] for r in near}), total + 5
        assert all(abs(r["score"] - u[r["vec_id"] // 5] @ u[q // 5]) < 1e-12 for r in near)
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, scratch).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in ann.nearest(few, F.col("vec_id") == 0, scratch).collect()] == [(0, 1, 1)]


def test_few_candidates_are_all_found(spark, scratch):
    v = np.random.default_rng(3).normal(size=(9, 64))
    v[1], v[8] = -v[0], -v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for choice in (None, (1, 1, 1), (2, 1, 4)):
        for n in (1, 2, 4, 9):
            found = ann.nearest(df.where(F.col("vec_id") < n), F.col("vec_id") == 0, scratch, choice=choice).orderBy("rank").collect()
            want = sorted(range(1, n), key=lambda i: (-round(ann.cosine(v[0], v[i]), 12), i))[:5]
            assert [(r["rank"], r["vec_id"]) for r in found] == list(enumerate(want, 1))


def test_pairs_of_hashes_probe_their_own_bucket_first():
    x = ann._unit(np.random.default_rng(5).normal(size=(50, 20)))
    for hashes in (1, 2):
        probed = ann.buckets_of(x, hashes, 3, 17, 16)
        assert (probed[:, 0] == ann.buckets_of(x, hashes, 3, 17, 1)[:, 0]).all() and all(len(set(r)) == 16 for r in probed.tolist())


# ---- licences


def test_licenses(spark):
    texts = [
        None, "", "x", "prose\nLicensed under the Apache License, Version 2.0.\nmore", "  released UNDER the mit   license!", "Released under the MIT", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
        "word " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache Licence version two of this and that and more.",
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["part"]): r["license"] for r in license.scan(df).collect()}

    def brute(line):
        g = set(license.bigrams(line))
        best = max(((2 * len(g & set(license.bigrams(t))) / (len(g) + len(license.bigrams(t))), -n, name) for n, (name, t) in enumerate(license.TEMPLATES)), default=(0,))
        return best[2] if g and best[0] >= 0.8 else None

    want = {(i, j): brute(line) for i, t in enumerate(texts) if t for j, line in enumerate(t.split("\n")) if brute(line)}
    assert got == want and len(want) >= 4
    assert license.scan(df.limit(0)).count() == 0
    assert "Python" not in license.scan(df)._jdf.queryExecution().executedPlan().toString()


# ---- quality


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 1) ** 3, 3) for _ in range(700)] + [5.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 39, 40, 41, 300, 739, 740):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_resampling_rejects_what_labels_reject(spark, scratch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            text[::9] = rng.choices(["awful", "rotten"], k=len(text[::9]))
        rows.append((i, " ".join(text), "c"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if bad and i % 4 == 0 else 1, int(bad)))
    rows += [(5000, None, "c"), (5001, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_weight string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(df, table, scratch).collect()}
    assert not kept & {i for i in range(1200) if i % 6 == 0}
    assert len(kept & {i for i in range(1200) if i % 6}) >= 0.97 * 1000
    assert {5000, 5001} <= kept
    assert quality.resample(df, table.limit(0), scratch).count() == len(rows)
    assert quality.resample(df.limit(0), table, scratch).count() == 0


# ---- decontamination


def test_tiling_finds_reordered_passages(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(2000)]
    item = [rng.choice(words) for _ in range(40)]
    other = [rng.choice(words) for _ in range(30)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [
        noise(200) + item + noise(100), noise(50) + item[20:] + noise(30) + item[:20], noise(10) + item[:20] + noise(5), noise(300), [w.upper() + "," for w in item],
        other + item, item[:8] + ["x"] + item[8:16] + ["x"] + item[16:24] + ["x"] + item[24:32] + ["x"] + item[32:], noise(20000) + item,
    ]
    df = spark.createDataFrame([(i, " ".join(t), "c") for i, t in enumerate(texts)] + [(90, None, "c"), (91, "", "c"), (92, "tiny test", "c")], "doc_id long, text string, coverage string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None), (10, ""), (11, "Tiny test!")], "item_id long, text string")
    want = {(0, 7), (1, 7), (4, 7), (5, 7), (5, 8), (6, 7), (7, 7), (92, 11)}
    for block in (decontam.BLOCK_WORDS, 35):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, items, block_words=block).collect()} == want
        assert {r["doc_id"] for r in decontam.clean(df, items, block_words=block).collect()} == {2, 3, 90, 91}
    assert decontam.contaminated(df, items.limit(0)).count() == 0 and decontam.clean(df, items.limit(0)).count() == df.count()


def _tiled(doc, item, least):
    """Greedy string tiling, by comparing all places."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(j, i)]
                elif n == best:
                    found.append((j, i))
        if not found:
            return tiles
        for j, i in sorted(found):
            if all(free_doc[i : i + best]) and all(free_item[j : j + best]):
                free_doc[i : i + best] = free_item[j : j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        letters = int(rng.integers(2, 6))
        doc, item = (rng.integers(1, letters + 1, int(rng.integers(1, most))).astype(np.uint64) for most in (60, 25))
        assert decontam.tile(doc, item, 3) == _tiled(doc.tolist(), item.tolist(), 3)


def test_a_repetitive_text_of_a_million_words():
    doc, item = np.array([5, 6, 7] * 333_333, np.uint64), np.array([5, 6, 7] * 20, np.uint64)
    began = time.perf_counter()
    (found,) = decontam.SeedIndex([1], [item], 5).matches(doc, np.array([0, len(doc)]), 0.8)
    assert found[:2] == (0, 0) and found[2] == [(0, 0, 60)] and time.perf_counter() - began < 60


def test_items_that_share_a_passage_are_each_found():
    passage = np.arange(1, 41, dtype=np.uint64)
    items = [np.concatenate([passage, np.full(3, 100 + n, np.uint64)]) for n in range(50)]
    found = list(decontam.SeedIndex(list(range(50)), items, 5).matches(np.concatenate([passage[20:], passage[:20]]), np.array([0, 40]), 0.8))
    assert sorted(n for _, n, _ in found) == list(range(50)) and all([x[2] for x in tiles] == [20, 20] for _, _, tiles in found)


def test_tiles_do_not_overlap():
    rng = np.random.default_rng(8)
    for _ in range(200):
        doc, item = rng.integers(1, 5, 40).astype(np.uint64), rng.integers(1, 5, 15).astype(np.uint64)
        used_doc, used_item, last = set(), set(), 99
        for i, j, n in decontam.tile(doc, item, 3):
            assert (doc[i : i + n] == item[j : j + n]).all() and 3 <= n <= last
            last = n
            assert not used_doc & set(range(i, i + n)) and not used_item & set(range(j, j + n))
            used_doc |= set(range(i, i + n))
            used_item |= set(range(j, j + n))


def test_licenses_across_lines(spark):
    whole = dict(license.WHOLE[5:])
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n"
    cases = [
        ("code\n" + "\n".join(whole["MIT"].split("\n")[:3]), {(1, "MIT")}),
        (gpl.format(3), {(0, "GPL-3.0")}),
        ("x\r\n" + gpl.format(2), {(1, "GPL-2.0")}),
        ("\n".join(whole["BSD-3-Clause"].split("\n")[:3]), {(0, "BSD-3-Clause")}),
        ("Thanks for reading this page. Released under the MIT License. See the file for details.", {(0, "MIT")}),
        ("It is licensed under CC BY 3.0 or so\nand under the terms of it.", set()),
        ("It is licensed under CC BY ND 4.0 or so", set()),
        *((text, {(next(i for i, x in enumerate(text.split("\n")) if x), name)}) for name, text in whole.items() if name not in ("Apache-2.0", "MPL-2.0")),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = [set() for _ in cases]
    for r in license.scan(df).collect():
        assert (r["part"], r["license"]) not in got[r["doc_id"]]
        got[r["doc_id"]].add((r["part"], r["license"]))
    assert got == [want for _, want in cases]
    for name in ("Apache-2.0", "MPL-2.0"):  # their notices stand within them too
        found = license.scan(spark.createDataFrame([(0, whole[name])], "doc_id long, text string")).collect()
        assert {r["license"] for r in found} == {name} and max(r["common"] for r in found) == len(license.bigrams(whole[name]))


def test_components_fail_when_rounds_run_out(spark, scratch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r["component"] for r in components(chain, scratch).collect()} == {0}
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, scratch, rounds=2)


def test_the_draw_follows_weights_and_noise(spark, scratch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words[:40] if i % 2 else words[20:], 30))) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {s: {r["doc_id"] for r in quality.resample(docs, labels, scratch, sharpness=s).collect()} for s in (0.01, 1.0, 1e6)}
    share = {s: sum(i % 2 for i in k) / len(k) for s, k in kept.items()}
    assert kept[1.0] != kept[1e6] and share[0.01] < share[1.0] <= share[1e6] and share[1e6] > 0.95 and share[0.01] < 0.65


# ---- packing

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_coder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = [None, "", "It's a\x1cTEST <|endoftext|> x<|startoftext|>y don't 'S!'s 12ab3 日本語 é İ ß µª 'tis !'re ’s Éé'LL", "a''s 'sx \t\r\n\x0b ¡¿ 3.14e5", "<|im_end|> a<|b", "ÀÖØöøÿ×÷", "x\u00a0y\u2003z\u0085w", "e\u0301 e \u0301"]
    real, coder = Tokenizer.from_file(PATH), packing.WordCoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in coder.encode(texts, 1)] == [real.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_coder_equals_the_tokenizer_at_signs_and_white_space():
    from tokenizers import Tokenizer

    rng, real, coder = np.random.default_rng(8), Tokenizer.from_file(PATH), packing.WordCoder(PATH)
    signs = list("aé7Sßt.,!&'-_`~[@/:\"(") + ["'s", "'re", " ", "  ", "\n", "\t", "\x0b", "...", "', ", "word", "Two", "Ünder", "×", "\x1c", "\x85", "\u0301", "<|", "|>"]
    texts = ["".join(signs[i] for i in rng.integers(0, n, rng.integers(1, 40))) for n in (28, 33, len(signs)) for _ in range(700)]
    for text, got in zip(texts, coder.encode(texts, 1)):
        assert got.tolist() == real.encode(text, add_special_tokens=False).ids + [1], text


def test_words_of_common_letters_go_to_the_model_alone(monkeypatch):
    coder = packing.WordCoder(PATH)
    text = "It's a test, of 12 wörds... (and 'more'); no\ttext\nhere runs <b>twice</b>."
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    monkeypatch.setattr(coder, "tokenizer", None)
    assert next(coder.encode([text], 1)).tolist() == want


def test_plans_are_packings_at_their_bound():
    rng = np.random.default_rng(4)
    for n, low, high in ((0, 1, 9), (1, 1, 64), (40, 1, 64), (300, 5, 40), (500, 20, 64), (60, 22, 43)):
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=65)
        found = packing.plan(counts, 64)
        used = np.zeros(65, int)
        for pattern, many in found:
            assert sum(pattern) <= 64 and many > 0
            for s in pattern:
                used[s] += many
        assert (used == counts).all()
        total = sum(m for _, m in found)
        bound = packing.lower_bound(counts, 64)
        assert bound <= total <= max(sum(m for _, m in packing.best_fit(counts, 64)), bound)


def _least_sequences(pieces, capacity):
    """The least number by trying all subsets."""
    full = (1 << len(pieces)) - 1
    size = [sum(x for i, x in enumerate(pieces) if m >> i & 1) for m in range(full + 1)]
    best = [0] + [len(pieces)] * full
    for m in range(1, full + 1):
        low, sub = m & -m, m
        while sub:
            if sub & low and size[sub] <= capacity:
                best[m] = min(best[m], 1 + best[m ^ sub])
            sub = (sub - 1) & m
    return best[full]


def test_bin_completion_finds_the_optimum_and_beats_best_fit():
    rng, won = np.random.default_rng(11), 0
    for _ in range(60):
        pieces = rng.integers(8, 60, 10).tolist()
        counts = np.bincount(pieces, minlength=101)
        found = sum(m for _, m in packing.plan(counts, 100))
        assert found == _least_sequences(pieces, 100)
        won += found < sum(m for _, m in packing.best_fit(counts, 100))
    assert won > 0


def test_one_length_of_many_pieces_needs_no_depth():
    counts = np.zeros(4097, int)
    counts[[1, 4000]] = 50_000, 3
    assert sum(m for _, m in packing.plan(counts)) == -(-62_000 // 4096)
    pool = packing.Pool(np.array([0, 5000] + [0] * 4095))
    assert next(packing.fillings(pool, 4000, 0)) == (1,) * 4000


def test_dominance():
    assert packing._dominated((3, 4), (7,)) and packing._dominated((3, 4), (8,)) and not packing._dominated((3, 5), (7,)) and packing._dominated((2, 2, 3), (4, 3)) and not packing._dominated((4, 4, 1), (5, 3))


def test_all_undominated_fillings():
    from itertools import combinations

    for pieces, room in (((1, 1, 2, 3, 3, 5, 8), 13), ((3, 4, 4, 5, 6, 7, 7), 19), ((2, 2, 2, 2, 2, 2, 9), 12), ((3, 5, 7, 11), 2), ((4, 4, 4, 4, 4, 4), 21)):
        counts = np.bincount(pieces, minlength=room + 1)
        every = {c[::-1] for k in range(len(pieces) + 1) for c in combinations(sorted(pieces), k) if sum(c) <= room}
        want = {b for b in every if not any(_covers(b, a) for a in every)}
        got = list(packing.fillings(packing.Pool(counts), room, room))
        assert set(got) == want and len(got) == len(want) and [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def _covers(b, a):
    return a != b and (packing._dominated(b, a) if len(b) >= len(a) else all(a.count(x) >= b.count(x) for x in b) or packing._dominated(b + (0,) * len(a), a))


def test_dives_complete():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(7, 0.8, 100_000).astype(int), 1, 4096), minlength=4097)
    found = packing.plan(counts)
    assert (np.bincount(np.repeat([s for p, _ in found for s in p], [m for p, m in found for _ in p]), minlength=4097) == counts).all()
    assert sum(m for _, m in found) < sum(m for _, m in packing.best_fit(counts, 4096))


def test_pack(spark, scratch):
    texts = [None, "", "a", "hello world " * 3000, "x y z", "x y z"] + ["same words here"] * 40
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    cut = packing.pieces(df, PATH, capacity=64)
    rows = packing.pack(scratch.write(cut, "pieces"), capacity=64, part_rows=7).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    coder = packing.WordCoder(PATH)
    for i, ids in enumerate(coder.encode(texts, 1)):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["ids"]] == ids.tolist() and [p["start"] for p in parts] == [64 * k for k in range(len(parts))]
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts[:-1])]).tolist() and sum(p["length"] for p in parts) <= 64
    assert len(by_seq) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(scratch.write(packing.pieces(df.limit(0), PATH), "none")).count() == 0


def test_vectors_of_several_lengths_are_searched_apart(spark, scratch):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (100, [1.0, 1.0, 0.0]), (150, [1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, rank int, q string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, scratch).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (50, 1, 100), (100, 1, 50)]
    many = spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(70)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        ann.nearest(many, F.lit(True), scratch)


def test_recall_on_vectors_that_were_not_tuned_on(spark, scratch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 4000)] + 0.5 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 8 == 0, scratch).toPandas()
    unit = ann._unit(x)
    score = unit[::8] @ unit.T
    score[np.arange(500), np.arange(0, 4000, 8)] = -2
    want = np.argsort(-score, axis=1)[:, :5]
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(found[8 * i] & set(w)) / 5 for i, w in enumerate(want.tolist())]) >= 0.95
    chosen = ann._chosen(*_index(spark, df), "double", 5, 0.95, 17)
    assert chosen[1] < 24  # not every bucket


def _index(spark, df):
    index = df.select(F.xxhash64("embedding").alias("h"), F.md5(F.concat_ws(",", "embedding")).alias("h2"), F.array("vec_id").alias("ids"), F.col("embedding").alias("v"))
    return index, index.where(F.col("ids")[0] % 8 == 0)


def test_labels_of_one_kind_are_an_error_or_keep_all(spark, scratch):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(4)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0)], [(1, 0, 0), (2, 0, 1)], [(7, 1, 0), (8, 0, 0)], [(None, 1, 0), (1, 0, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        with pytest.raises(ValueError, match="both good and bad"):
            quality.resample(docs, labels, scratch, one_kind="error").collect()
        assert quality.resample(docs, labels, scratch, one_kind="keep").count() == 4
    assert quality.resample(docs.limit(0), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"), scratch, one_kind="error").count() == 0


def test_log_weights_equal_two_plain_models(spark, scratch):
    """The weight of each document, from two dictionaries of counts."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    words = {"good": [f"alpha{i}" for i in range(40)], "bad": [f"omega{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(words["good" if i % 3 else "bad"], 60)) + ("; the end." if i % 2 else "")) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "?!"), (3, rows[3][1]), (None, rows[4][1])]
    good = [i for i in range(1, 40) if i % 3]
    grams = []
    for _, t in rows:
        (_, buckets, _), *rest = quality.features(pa.array([t], pa.string()))
        assert not rest
        grams.append(buckets.tolist())
    tokens = re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+", rows[0][1])
    assert len(grams[0]) == 2 * len(tokens) - 1 + sum(len(t) > n for t in tokens for n in quality.PREFIXES)
    raw, target = collections.Counter(), collections.Counter()
    for (key, _), g in zip(rows, grams):
        raw.update(g)
        if key in good:
            target.update(g)

    def weight(key, g):
        less = collections.Counter(g) if key in good else collections.Counter()
        share = (sum(target.values()) - sum(less.values())) / (sum(raw.values()) - sum(less.values()))
        total = 0.0
        for b in g:
            t, e = target[b] - less[b], (raw[b] - less[b]) * share
            if abs(t - e) >= quality.Z * math.sqrt(e + 1):
                total += math.log((t + quality.PSEUDO) / (e + quality.PSEUDO))
        return round(total / math.sqrt(max(len(g), 1)), 9)

    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, log_weight string")
    model = quality.fit(docs, np.array(good))
    got = quality.weigh(docs, model).collect()
    want = sorted(((k, t, weight(k, g)) for (k, t), g in zip(rows, grams)), key=repr)
    assert [r[:2] for r in want] == [(r["doc_id"], r["text"]) for r in sorted(got, key=lambda r: repr((r["doc_id"], r["text"])))]
    assert np.allclose([r[2] for r in want], [r["log_weight"] for r in sorted(got, key=lambda r: repr((r["doc_id"], r["text"])))], atol=1e-8)
    assert len({w for *_, w in want}) > 20
