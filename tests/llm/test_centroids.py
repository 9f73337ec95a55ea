from __future__ import annotations

import hashlib

import numpy as np
import pytest

from ledgerlens.llm import centroids as C


def lloyd(rows, k, rounds, width, scale, seed=1):
    """Every centroid is scanned, in Python's own whole numbers."""
    kept = [(key, [int(np.floor(float(x) * scale)) for x in v]) for key, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((key, near(v)[1], near(v)[0]) for key, v in kept), key=repr), at


def run(spark, scratch, rows, k=5, rounds=3, width=3, scale=8):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    found, at = C.cluster(df, scratch, k=k, rounds=rounds, width=width, scale=scale)
    want, centers = lloyd(rows, k, rounds, width, scale)
    assert sorted((tuple(r) for r in found.select("key", "cluster", "distance").collect()), key=repr) == want
    assert at.tolist() == centers


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_full_scan(spark, scratch, seed):
    rng = np.random.default_rng(seed)
    # few values, so that many distances are equal
    rows = [(int(i), (rng.integers(-3, 4, 3) / 4).tolist()) for i in range(300)]
    run(spark, scratch, rows, k=[1, 6, 17][seed])


def test_edges(spark, scratch):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (2, [-0.0, -1e-9, 5.0]), (3, None), (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 1.0]), (7, [inf, 0.0, 0.0]), (8, [nan, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (9, [0.0, 0.0, 0.0]), (10, [1.0] * 4)]
    for k in (2, 5, 50):
        run(spark, scratch, rows, k=k)
    run(spark, scratch, [])
    run(spark, scratch, [(1, [1.0, 1.0, 1.0])] * 6, k=3)  # equal centroids: all but the first stay empty
    run(spark, scratch, [(1, [16777215.9, -16777216.0, 0.0]), (2, [0.0, 0.0, 0.0])], k=1)
    with pytest.raises(Exception, match="a component is beyond"):
        run(spark, scratch, [(1, [1e9, 0.0, 0.0])])


def test_ball_leaves_most_centroids_unscanned():
    rng = np.random.default_rng(4)
    middle = rng.integers(-4000, 4000, (64, 8))
    x = (middle[rng.integers(0, 64, 20_000)] + rng.integers(-60, 60, (20_000, 8))).astype(np.int64)
    now = C.Centroids.of(x[:64].copy())
    c, u, low = C.start(x, now)
    for _ in range(4):
        after = C.moved_to(now.at, [(j, i, int((c == j).sum()), int(x[c == j, i].sum())) for j in range(64) for i in range(8) if (c == j).any()])
        moved = np.sqrt(C.squared(after, now.at).astype(float)) * (1 + C.SLACK)
        now = C.Centroids.of(after)
        u = u + moved[c]
        low = low - moved.max()
        made = C.search(x, c, u, low, now)
        exact = np.stack([C.squared(x, p) for p in now.at], 1)
        assert (c == exact.argmin(1)).all()
        two = np.sort(np.sqrt(exact.astype(float)), axis=1)
        assert (u >= two[:, 0]).all() and (low <= two[:, 1]).all()
        assert made < 0.35 * exact.size
