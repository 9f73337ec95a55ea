"""Centroid clustering of integer vectors by Exponion search, exact in every tie.

Lloyd's rounds over vectors of whole numbers. Each vector keeps its centroid, an upper bound
of the distance to it and a lower bound of the distance to any other. In a round:

1. The bounds are moved by how far the centroids have moved. Where the upper bound is below
   the lower one, or below half the distance from the centroid to its nearest neighbour, the
   nearest centroid is the same and no distance is computed.
2. Else the distance to the own centroid is computed, and both tests are made again.
3. Else only the centroids in a ball around the own centroid are scanned: those up to
   2 u + s away from it, where u is the distance found and s that between the centroid and
   its nearest neighbour. They are the head of a list of centroids sorted by their distance
   from this one, read in annuli of doubling length. The ball holds the nearest and the
   second nearest centroid; its radius is inclusive and rounded up, so a centroid at an equal
   distance is always scanned.

Distances are compared as whole numbers; bounds are floating point and rounded outwards, and
only decide what is scanned. So the result is that of scanning every centroid.

On Spark: the vectors with their bounds are a table in the shared folder, written once a
round by a map over batches, without a shuffle; counts and sums of each centroid's components
come from map-side aggregates of k x width rows a task, and the driver holds k centroids
only. Any task or executor can be lost: every round starts from a written table.

Bounds: k x width numbers (centroids and sums) and k x k distances are held by the driver and
sent to the tasks; nothing else is.

Defined results: a vector that is null, of another width, or holds a null or non-finite
component takes no part; a null key is the last choice as a first centroid, and its vector is
clustered; repeated rows are vectors of their own; fewer vectors than ``k`` make as many
centroids; an empty centroid stays where it is; ties go to the smaller number; an empty table
gives no rows; other columns are ignored. Whole numbers beyond ``LIMIT`` raise an error: their
squared distance would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: most whole number of a component, over the root of the width's share of 64 bits
LIMIT = 1 << 27
#: relative error allowed to the bounds, far above that of a root
SLACK = 1e-9
#: rows worked on at once
BLOCK = 8192
STATE, FOUND = "key long, v array<long>, c int, u double, l double", "key long, cluster int, distance long"


@dataclass
class Centroids:
    """Whole-number centroids and what the search needs to know of them."""

    at: np.ndarray  # k x width
    order: np.ndarray  # of each: the others, nearest first
    gaps: np.ndarray  # their distances, rounded down
    half: np.ndarray  # half the distance to the nearest other, rounded down
    near: np.ndarray  # the distance to the nearest other, rounded up

    @classmethod
    def of(cls, at: np.ndarray) -> Centroids:
        apart = np.sqrt(np.stack([squared(at, c) for c in at]).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        order = np.argsort(apart, axis=1, kind="stable")[:, :-1]
        gaps = np.take_along_axis(apart, order, 1) * (1 - SLACK)
        nearest = gaps[:, 0] if len(at) > 1 else np.full(len(at), np.inf)
        return cls(at, order, gaps, nearest / 2, nearest * (1 + 3 * SLACK))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point, or row by row, in whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def search(x: np.ndarray, c: np.ndarray, u: np.ndarray, low: np.ndarray, now: Centroids) -> int:
    """Update assignments and bounds of rows in place; the number of distances computed."""
    made = 0
    todo = np.flatnonzero(u >= np.maximum(low, now.half[c]))
    if not len(todo):
        return made
    exact = squared(x[todo], now.at[c[todo]])
    made += len(todo)
    u[todo] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    left = u[todo] >= np.maximum(low[todo], now.half[c[todo]])
    todo, exact = todo[left], exact[left]
    if len(now.at) < 2:
        return made
    before = c[todo]
    for own in np.unique(before):
        mine = np.flatnonzero(before == own)
        rows = todo[mine]
        inside = np.searchsorted(now.gaps[own], 2 * u[rows] + now.near[own], "right")
        best, first = exact[mine].copy(), np.full(len(rows), own, np.int64)
        second = np.full(len(rows), np.iinfo(np.int64).max)
        low_end, high_end = 0, 1
        while low_end < len(now.at) - 1:  # the ball's list, in annuli of doubling length
            live = np.flatnonzero(inside > low_end)
            if not len(live):
                break
            for j in now.order[own][low_end:high_end]:
                d = squared(x[rows[live]], now.at[j])
                made += len(live)
                wins = (d < best[live]) | ((d == best[live]) & (j < first[live]))
                second[live] = np.where(wins, best[live], np.minimum(second[live], d))
                best[live], first[live] = np.where(wins, d, best[live]), np.where(wins, j, first[live])
            low_end, high_end = high_end, high_end * 2
        c[rows] = first
        u[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        # no scanned centroid is second: all others are beyond the ball
        beyond = np.where(second == np.iinfo(np.int64).max, now.near[own], np.sqrt(second.astype(np.float64)))
        low[rows] = beyond * (1 - 8 * SLACK)
    return made


def start(x: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Assignments and bounds of rows that have none: every centroid is scanned."""
    apart = np.stack([squared(x, c) for c in now.at], 1)
    c = apart.argmin(1)  # the first of equals
    best = np.take_along_axis(apart, c[:, None], 1)[:, 0]
    np.put_along_axis(apart, c[:, None], np.iinfo(np.int64).max, 1)
    second = np.sqrt(apart.min(1).astype(np.float64)) if apart.shape[1] > 1 else np.full(len(x), np.inf)
    return c, np.sqrt(best.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)


def whole_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(key, v): floor(scale * component) of the vectors that take part."""
    at = F.col(f"`{vector}`")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = df.where(at.isNotNull() & (F.size(at) == width) & ~F.exists(at, bad))
    far = lambda x: F.abs(x.cast("double") * scale) > LIMIT
    checked = F.when(F.exists(at, far), F.raise_error(F.lit(f"a component is beyond {LIMIT} / {scale}")).cast("array<long>"))
    return kept.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(checked, F.transform(at, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v"))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _round(width: int, now, moved: np.ndarray | None, last: bool):
    """A map over batches: of the vectors (no bounds yet), or of the state of the round before.

    Gives the next state or, at last, assignments and squared distances.
    """

    def run(batches):
        held: Centroids = now.value
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x = _vectors(b.column(1), width)
                if moved is None:
                    c, u, low = start(x, held)
                else:
                    c, u, low = (b.column(j).to_numpy().copy() for j in (2, 3, 4))
                    c = c.astype(np.int64)
                    u += moved[c]
                    # the farthest move of any other centroid
                    most = int(moved.argmax())
                    other = np.partition(moved, -2)[-2] if len(moved) > 1 else 0.0
                    low -= np.where(c == most, other, moved[most])
                    search(x, c, u, low, held)
                chosen = pa.array(c.astype(np.int32))
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(0), chosen, pa.array(squared(x, held.at[c]))], names=["key", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chosen, pa.array(u), pa.array(low)], names=["key", "v", "c", "u", "l"])

    return run


def _sums(width: int):
    """Of each task: (c, i, n, s), the count and the sum of each component of each centroid."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        many: dict[int, int] = {}
        for b in batches:
            x, c = _vectors(b.column(1), width), b.column(0).to_numpy()
            for j in np.unique(c).tolist():
                mine = x[c == j]
                total[j] = total.get(j, 0) + mine.sum(0)
                many[j] = many.get(j, 0) + len(mine)
        for j, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([many[j]] * width, pa.int64()), pa.array(s)], names=["c", "i", "n", "s"])

    return run


def moved_to(at: np.ndarray, sums: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The centroids after a round: exact floors of the means; empty ones stay."""
    out = at.copy()
    for c, i, n, s in sums:
        out[c, i] = int(s) // int(n)
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<key>``, in that order; ties by vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def cluster(df: DataFrame, scratch, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that takes part, and the final centroids.

    ``rounds`` times every vector is assigned and the centroids move; then vectors are
    assigned once more. ``distance`` is squared. ``scratch`` holds a table for each round.
    """
    spark = df.sparkSession
    rows = scratch.write(whole_vectors(df, key, vector, width, scale), "vectors")
    at, moved, before = first_centroids(rows, k, seed), None, "vectors"
    if not len(at):
        return rows.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), at
    for i in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Centroids.of(at))  # k x (width + k) numbers
        last = i == rounds
        rows = scratch.write(rows.mapInArrow(_round(width, shared, moved, last), FOUND if last else STATE), f"round{i}")
        shared.destroy()
        scratch.drop(before)
        before = f"round{i}"
        if last:
            break
        sums = rows.select("c", "v").mapInArrow(_sums(width), "c int, i int, n long, s long").groupBy("c", "i").agg(F.sum("n"), F.sum("s")).collect()  # k x width rows
        after = moved_to(at, [tuple(r) for r in sums])
        moved, at = np.sqrt(squared(after, at).astype(np.float64)) * (1 + SLACK), after
    return rows, at


def summary(found: DataFrame) -> DataFrame:
    """(cluster, n, cluster_inertia): at most k rows."""
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("cluster_inertia"))


def digest(centroid: np.ndarray) -> str:
    """The hex sha256 of a centroid's components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
