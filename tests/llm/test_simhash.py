from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash as S


def plain_fingerprint(text, k=4):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    fps = sorted(up)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "One TWO", "one two three four", "one two three four five", "a b c d a b c d a b c d", "ÉA b \x1cc\x00 d e", "x " * 9000, "w" * 40_000, "one  two\tthree\nFOUR"]


def test_fingerprints_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in S.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("one two three four",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def check(spark, scratch, texts, **more):
    rows = [(i * 7 % 1009 if t != "null key" else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n int")
    got = S.similar_documents(df, scratch, **more).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = plain_components(set(fps), more.get("radius", 4))
    least = {}
    for (key, *_), f in zip(rows, fps):
        if key is not None:
            least[label[f]] = min(key, least.get(label[f], key))
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], f"{f:016x}", least.get(label[f])) for r, f in zip(rows, fps)), key=repr)
    return label


def near_copies(rng, groups, copies, length):
    out, words = [], [f"w{i}" for i in range(3000)]
    for _ in range(groups):
        text = rng.choice(words, length).tolist()
        for _ in range(copies):
            own = list(text)
            for at in rng.integers(0, length, int(rng.integers(0, 6))):
                own[at] = str(rng.choice(words))
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("pieces", [None, 5, 6, 8])
def test_components_equal_brute_force(spark, scratch, pieces):
    rng = np.random.default_rng(5)
    texts = [*TEXTS, *TEXTS[3:6], "null key", *near_copies(rng, 12, 12, 300), *near_copies(rng, 1, 60, 500)]
    label = check(spark, scratch, texts, pieces=pieces)
    assert len(set(label.values())) < len(label) - 30


def test_large_bucket_is_cut(spark, scratch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(base ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(60, 3, replace=False)), np.uint64(0)) & np.uint64((1 << 60) - 1)) for _ in range(700)}
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    want = plain_components(fps, 2)
    for tile in (64, 4096):
        edges = S.links(df, scratch, radius=2, tile=tile).collect()
        up = {f: f for f in fps}

        def root(f, up=up):
            while up[f] != f:
                f = up[f]
            return f

        for r in edges:
            a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
            assert want[a] == want[b]
            up[max(root(a), root(b))] = min(root(a), root(b))
        assert {f: root(f) for f in fps} == want


def test_empty_and_radius_zero(spark, scratch):
    check(spark, scratch, [])
    check(spark, scratch, ["a b c d e", "a b c d e", "f g h", None], radius=0)


def test_counters_equal_distances():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0x0F0F)  # many close
    fp = np.sort(fp)
    bits = list(range(64))
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for radius in (0, 1, 3, 4, 6):
        a, b = S.linked(fp, np.zeros(400, np.int64), np.zeros(400, np.int64), radius, bits)
        assert sorted(zip(a, b)) == [(i, j) for i in range(400) for j in range(i + 1, 400) if far[i, j] <= radius]
        side = np.repeat([0, 1], [150, 250])
        a, b = S.linked(fp, side, np.zeros(400, np.int64), radius, bits)
        assert sorted(zip(a, b)) == [(i, j) for i in range(150) for j in range(150, 400) if far[i, j] <= radius]


def test_tables_meet_all_within_the_radius():
    rng = np.random.default_rng(9)
    for pieces in (5, 6, 7, 8):
        masks = S.tables_of(pieces, 4)
        for _ in range(200):
            differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not differ & m for m in masks)
    assert [S.pieces_for(n, 4) for n in (0, 10**5, 10**6, 10**9, 10**13)] == [5, 5, 6, 7, 8]
