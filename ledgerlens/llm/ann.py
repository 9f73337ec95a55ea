"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit
vector; its nearest signed axis is its hash. A bucket is one hash or, where that is cheaper,
two of different rotations. Each table has its own rotations. A query probes the buckets of
its largest signed coordinates in each table; every bucket's vectors are compared exactly, in
double precision, and the best of all buckets are ranked.

``tune`` picks hashes, tables and probes: the cheapest (by the share of a bounded sample that
is compared) whose recall, less two standard errors, reaches a target for a bounded sample of
the rows that are not queries, whose true neighbours are found by one exact scan of all rows.
So the queries' recall is that of vectors that were not tuned on, and the share of pairs that
is compared falls as a larger table brings nearer neighbours; where neighbours are far, it is
large, and if nothing else reaches the target, every bucket is probed. Queries whose buckets
hold fewer than ``k`` others probe every bucket afterwards, which is exact.

Equal vectors are one vector with the ids of its ``k + 1`` least: more can be in no answer.
The rows and the queries of a large bucket are cut into blocks, so no task holds a large one.

Defined results: null, zero or non-finite vectors take no part; vectors of different lengths
are searched apart, each length among its own (more than ``WIDTHS`` lengths are an error); with
fewer candidates than ``k`` all are returned; ties in score go to the smaller id; no rows give
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bounds of the samples that ``tune`` works on
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 256
#: most different lengths of vectors
WIDTHS = 64
#: hashes of a bucket, tables and probes to choose from
CHOICES = tuple((1, t, p) for t in (1, 2, 3, 4, 6) for p in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)) + tuple((2, t, p) for t in (1, 2, 3, 4, 6) for p in (1, 4, 16, 64, 256))
#: axes of a rotation that pairs of hashes are probed from, and the longest vectors that have such pairs
AXES, PAIR_WIDTH = 32, 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The table's pseudo-rotation of unit rows, padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def probes_of(rotated: np.ndarray, count: int) -> np.ndarray:
    """The numbers of the ``count`` nearest signed axes, nearest first: 2i for +, 2i + 1 for -."""
    both = np.stack([rotated, -rotated], 2).reshape(len(rotated), -1)
    count = min(count, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vector: Column, width: int | None = None) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)
    return ok if width is None else ok & (F.size(vector) == width)


def buckets_of(x: np.ndarray, hashes: int, table: int, seed: int, probes: int) -> np.ndarray:
    """The numbers of the buckets of unit rows that are probed first, nearest first; -1 where there are no more."""
    turned = [rotate(x, table * 2 + i, seed) for i in range(hashes)]
    if hashes == 1:
        return probes_of(turned[0], probes)
    tops = [probes_of(r, min(probes, AXES)) for r in turned]
    near = [np.take_along_axis(np.stack([r, -r], 2).reshape(len(r), -1), t, 1) for r, t in zip(turned, tops)]
    both = (near[0][:, :, None] + near[1][:, None, :]).reshape(len(x), -1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
    number = tops[0][:, :, None].astype(np.int64) * (2 * turned[0].shape[1]) + tops[1][:, None, :]
    return np.take_along_axis(number.reshape(len(x), -1), order, 1)


def tune(sample: np.ndarray, queries: np.ndarray, near: np.ndarray, owner: np.ndarray, target: float, seed: int) -> tuple[int, int, int]:
    """The cheapest (hashes, tables, probes) that finds that share of the neighbours.

    ``near`` has the true neighbours of all queries, ``owner`` the number of each one's query.
    Last is a table whose every bucket is probed. The share is that of the sample less two
    standard errors of its mean over queries.
    """
    many = np.maximum(np.bincount(owner, minlength=len(queries)), 1)
    asked = np.bincount(owner, minlength=len(queries)) > 0

    def sure(found: np.ndarray) -> float:
        each = (np.bincount(owner, found, len(queries)) / many)[asked]
        return each.mean() - 2 * each.std() / np.sqrt(len(each))

    every = (1, 1, 2 << max(1, (sample.shape[1] - 1).bit_length()))
    best, least = every, 1.0
    for hashes in (1, 2) if sample.shape[1] <= PAIR_WIDTH else (1,):
        most = max(p for h, _, p in CHOICES if h == hashes)
        met, cost = [], []  # by table: the probe that meets each neighbour, and the share of the sample met up to each probe
        for t in range(max(c[1] for c in CHOICES)):
            probed = buckets_of(queries, hashes, t, seed, most)
            most = probed.shape[1]
            own = buckets_of(near, hashes, t, seed, 1)[:, 0]
            hit = probed[owner] == own[:, None]
            met.append(np.where(hit.any(1), hit.argmax(1), most))
            place, size = np.unique(buckets_of(sample, hashes, t, seed, 1)[:, 0], return_counts=True)
            at = np.minimum(np.searchsorted(place, probed), len(place) - 1)
            cost.append(np.cumsum(np.where(place[at] == probed, size[at], 0).mean(0)) / len(sample))
        for h, tables, probes in CHOICES:
            price = sum(c[min(probes, most) - 1] for c in cost[:tables])
            if h == hashes and price < least and sure(np.min(met[:tables], axis=0) < probes) >= target:
                best, least = (h, tables, probes), price
    return best


def _assign(choice: tuple[int, int, int], seed: int, all_probes: bool):
    """Rows once for each table and probe, with ``_table`` and ``_bucket``."""
    hashes, tables, probes = choice

    def run(frames):
        for f in frames:
            if len(f):
                x = _unit(np.array(f["v"].tolist(), np.float64))
                for t in range(tables):
                    axes = buckets_of(x, hashes, t, seed, probes if all_probes else 1)
                    for p in range(axes.shape[1]):
                        out = f.copy()
                        out["_table"], out["_bucket"] = np.int32(t), axes[:, p].astype(np.int32)
                        yield out

    return run


def _best_of(queries: np.ndarray, names: list[tuple[int, str]], k: int):
    """Of each task: the k nearest to each of the queries, other vectors than the query's own."""

    def run(frames):
        best: list[list[tuple[float, list]]] = [[] for _ in names]
        for f in frames:
            if len(f):
                score = queries @ _unit(np.array(f["v"].tolist(), np.float64)).T
                at = {(h, h2): i for i, (h, h2) in enumerate(zip(f["h"], f["h2"]))}
                for i, name in enumerate(names):
                    if name in at:
                        score[i, at[name]] = -2
                top = np.argsort(-score, axis=1)[:, :k]
                for i in range(len(names)):
                    more = [(float(score[i, j]), f["v"].iloc[j]) for j in top[i] if score[i, j] > -2]
                    best[i] = sorted(best[i] + more, key=lambda x: -x[0])[:k]
        yield pd.DataFrame({"q": [i for i, b in enumerate(best) for _ in b], "score": [x[0] for b in best for x in b], "v": [x[1] for b in best for x in b]})

    return run


def _chosen(index: DataFrame, asked: DataFrame, element: str, k: int, recall: float, seed: int) -> tuple[int, int, int]:
    """``tune`` on a sample of the rows, and of those that are not asked for, with these ones' neighbours among all rows."""
    rows = [np.array(r[0], np.float64) for r in index.orderBy(F.xxhash64("h", F.lit(seed))).limit(SAMPLE_ROWS).select("v").toLocalIterator()]
    others = index.join(asked.select("h", "h2"), ["h", "h2"], "left_anti")
    some = others.orderBy(F.xxhash64("h", F.lit(seed + 1)), "h2").limit(SAMPLE_QUERIES).select("h", "h2", "v").collect()
    if not some or len(rows) < 2:
        return 1, 1, 1 << 30
    queries = _unit(np.array([r["v"] for r in some], np.float64))
    found = index.mapInPandas(_best_of(queries, [(r["h"], r["h2"]) for r in some], k), f"q int, score double, v array<{element}>")
    top = lambda c: F.slice(F.sort_array(c, asc=False), 1, k).alias("near")
    found = found.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(64))).agg(top(F.collect_list(F.struct("score", "v"))))  # k of a task, in 64 lists for each query
    found = found.groupBy("q").agg(top(F.flatten(F.collect_list("near"))))
    near = [(r["q"], np.array(x["v"], np.float64)) for r in found.toLocalIterator() for x in r["near"]]
    if not near:
        return 1, 1, 1 << 30
    return tune(_unit(np.array(rows)), queries, _unit(np.array([v for _, v in near])), np.array([q for q, _ in near]), recall, seed)


def nearest(df: DataFrame, is_query: Column, scratch, key: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = 0.95, seed: int = 17, block: int = 4096, choice: tuple[int, int, int] | None = None) -> DataFrame:
    """query_id, rank, ``vec_id`` and score: for each query row, its k nearest other rows.

    ``choice`` sets hashes, tables and probes; else they are tuned for ``recall``. ``scratch``
    holds the written tables.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    element = kind if kind in ("float", "double") else "double"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(valid(F.col("v")))
    # a row for each length
    widths = sorted(r[0] for r in rows.where("q").groupBy(F.size("v").alias("width")).count().limit(WIDTHS + 1).collect())
    if len(widths) > WIDTHS:
        raise ValueError(f"the queries have more than {WIDTHS} different lengths")
    found = [_nearest(rows.where(F.size("v") == w), element, scratch, k, recall, seed, block, choice, f"{w}") for w in widths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, element: str, scratch, k: int, recall: float, seed: int, block: int, choice: tuple[int, int, int] | None, mark: str) -> DataFrame:
    """``nearest`` of vectors of one length; ``mark`` is for the names of the tables."""
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("h2", F.md5(F.concat_ws(",", "v")))

    # equal vectors: the least ids of each, found in salted parts first
    least = rows.select("h", "h2", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)
    least = least.groupBy("h", "h2", "salt").agg(ids.alias("ids"))
    least = least.groupBy("h", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    first = rows.groupBy("h", "h2").agg(F.first("v").alias("v"))
    index = scratch.write(least.join(first, ["h", "h2"]).select("h", "h2", "ids", "v"), f"index{mark}")
    asking = scratch.write(rows.where("q").select(F.col("vec_id").alias("query_id"), "h", "h2"), f"asking{mark}")
    asked = index.join(asking.select("h", "h2").distinct(), ["h", "h2"], "left_semi").select("h", "h2", "v")
    choice = choice or _chosen(index, asked, element, k, recall, seed)

    found = scratch.write(_found(index, asked, element, choice, k, seed, block), f"found{mark}")
    # a query of too few rows meets every bucket; the k nearest are fewer where there are no more
    others = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    enough = F.aggregate("near", F.lit(0), lambda n, x: n + F.size(x["ids"])) >= min(k + 1, others)
    short = scratch.write(asked.join(found.where(enough), ["h", "h2"], "left_anti"), f"short{mark}")
    found = found.where(enough)
    if not short.isEmpty():
        found = found.unionByName(_found(index, short, element, (1, 1, 1 << 30), k, seed, block))
    pairs = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(n["s"].alias("s"), i.alias("id")))))
    others = F.filter(F.array_sort(pairs), lambda p: p["id"] != F.col("query_id"))
    ranked = asking.join(found, ["h", "h2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "p"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score"))


def _found(index: DataFrame, asked: DataFrame, element: str, choice: tuple[int, int, int], k: int, seed: int, block: int) -> DataFrame:
    """h, h2 of each asked vector and the ``near`` vectors of its buckets: score and ids, nearest first."""
    dealt = index.select("ids", "v").mapInPandas(_assign(choice, seed, False), f"ids array<long>, v array<{element}>, _table int, _bucket int")
    probing = asked.mapInPandas(_assign(choice, seed, True), f"h long, h2 string, v array<{element}>, _table int, _bucket int")
    # buckets are tables x axes, or x pairs of axes of at most PAIR_WIDTH; queries only meet buckets with rows
    cut = lambda d, name: d.groupBy("_table", "_bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(cut(dealt, "_blocks").join(cut(probing, "_asks"), ["_table", "_bucket"]))
    part = lambda h, n: F.pmod(F.xxhash64(*h), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = dealt.join(sizes, ["_table", "_bucket"]).withColumn("_block", part([F.col("ids")[0]], "_blocks")).withColumn("_ask", every("_asks")).drop("_blocks", "_asks")
    probing = probing.join(sizes, ["_table", "_bucket"]).withColumn("_ask", part(["h", "h2"], "_asks")).withColumn("_block", every("_blocks")).drop("_blocks", "_asks")

    def compare(_, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        cols = {"h": [], "h2": [], "ids": [], "score": []}
        if len(ask) and len(have):
            xs, ids = np.array(have["v"].tolist(), np.float64), have["ids"].to_numpy()
            unit = _unit(xs)
            for i in range(0, len(ask), 256):
                qs = np.array(ask["v"].iloc[i : i + 256].tolist(), np.float64)
                rough = _unit(qs) @ unit.T
                # the query's own vector stands for its copies, too; one more place is for it
                m = min(k + 1, rough.shape[1])
                top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
                floor = np.take_along_axis(rough, top, 1).min(1) - 1e-12
                for j in range(len(qs)):
                    near = np.flatnonzero(rough[j] >= floor[j])
                    if len(near) > m:  # ties at the edge: least ids
                        near = np.array(sorted(near, key=lambda c: (-round(rough[j, c], 12), ids[c][0]))[: m + 1])
                    cols["h"] += [ask["h"].iloc[i + j]] * len(near)
                    cols["h2"] += [ask["h2"].iloc[i + j]] * len(near)
                    cols["ids"] += [[int(v) for v in ids[c]] for c in near]
                    cols["score"] += [cosine(qs[j], xs[c]) for c in near]
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in cols.items()})

    keys = ["_table", "_bucket", "_block", "_ask"]
    found = probing.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(compare, "h long, h2 string, ids array<long>, score double")
    found = found.groupBy("h", "h2", F.col("ids")[0].alias("lead")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    # at most tables x probes x blocks x (k + 2) different vectors for each asked vector
    near = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("lead"), F.col("ids"))))
    return found.groupBy("h", "h2").agg(F.slice(near, 1, k + 1).alias("near"))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, safe for very large and very small components."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float((a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)))
