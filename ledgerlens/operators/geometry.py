"""Superposition, contact distances and compositions of structures.

Superposition is an Arrow kernel that sees one tile of a cluster; all else is expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import runs as R
from ledgerlens.functions.metrics import describe
from ledgerlens.operators.joins import tiled
from ledgerlens.sources.stage import checkpointed


def kabsch_rmsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """RMSD of point sets [pairs, points, 3] after the best proper rotation."""
    p = p - p.mean(1, keepdims=True)
    q = q - q.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd(np.swapaxes(p, 1, 2) @ q)
    s[:, -1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
    total = (p * p).sum((1, 2)) + (q * q).sum((1, 2)) - 2 * s.sum(1)
    return np.sqrt(np.maximum(total, 0) / p.shape[1])


def cross_rmsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """RMSD [a, b] of each of the point sets [a, points, 3] to each of [b, points, 3], all centred at 0.

    The singular values s of the product H of two sets are not needed one by one: the largest
    comes from the invariants of H'H, and (s2 + s3)^2 = |H|^2 - s1^2 + 2 det H / s1, where s3 has
    the sign of det H. Where that loses digits (nearly equal values, or points near a line), the
    decomposition is made.
    """
    h = [[np.ascontiguousarray(p[:, :, i]) @ np.ascontiguousarray(q[:, :, k].T) for k in range(3)] for i in range(3)]
    minor = lambda i, k: h[(i + 1) % 3][(k + 1) % 3] * h[(i + 2) % 3][(k + 2) % 3] - h[(i + 1) % 3][(k + 2) % 3] * h[(i + 2) % 3][(k + 1) % 3]
    one, two, det = np.zeros(h[0][0].shape), np.zeros(h[0][0].shape), np.zeros(h[0][0].shape)
    for i in range(3):
        for k in range(3):
            m = minor(i, k)
            one += h[i][k] * h[i][k]
            two += m * m
            if i == 0:
                det += h[i][k] * m
    with np.errstate(all="ignore"):
        spread = (one * one - 3 * two) / 9
        root = np.sqrt(np.maximum(spread, 0))
        turn = (one * one * one / 27 - one * two / 6 + det * det / 2) / (root * spread)
        s1 = np.sqrt(one / 3 + 2 * root * np.cos(np.arccos(np.clip(turn, -1, 1)) / 3))
        rest = one - s1 * s1 + 2 * det / s1
        total = s1 + np.sqrt(np.maximum(rest, 0))
        hard = (spread < 1e-4 * one * one) | (rest < 1e-4 * one) | (one == 0)
    a, b = np.nonzero(hard)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        u, s, vt = np.linalg.svd(np.swapaxes(p[x], 1, 2) @ q[y])
        s[:, -1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
        total[x, y] = s.sum(1)
    total = (p * p).sum((1, 2))[:, None] + (q * q).sum((1, 2))[None, :] - 2 * total
    return np.sqrt(np.maximum(total, 0) / p.shape[1])


def loop_points(mask: Column, points: Column, rule: str = "last") -> Column:
    """Points of a run of the mask (last, or third_or_last); null with a NaN or under three."""
    found = R.true_runs(mask)
    run = R.last_run(found) if rule == "last" else R.third_or_last(found)
    cut = R.cut_array(points, run)
    bad = F.exists(cut, lambda p: p.isNull() | F.exists(p, lambda x: x.isNull() | F.isnan(x)))
    return F.when(run.isNotNull() & (F.size(cut) >= 3) & ~bad, cut)


def pair_rmsd(df: DataFrame, cluster: str, key: str, points: str, tile: int = 1024, max_size: int | None = None) -> DataFrame:
    """(cluster, a, b, rmsd) of pairs of equal length; clusters over ``max_size`` are left out.

    Which ones are left out is told by ``skipped_clusters``; a cluster's pairs are met in tiles of
    ``tile`` rows by as many. Points are three numbers each; rows with a null point are left out.
    """
    flat = F.flatten(F.col(points).cast("array<array<double>>"))  # one buffer of numbers for the kernel
    rows = df.withColumn("_len", F.size(points)).withColumn("_flat", flat).where(F.col("_flat").isNotNull() & (F.col("_len") >= 3))
    if max_size is not None:
        rows = rows.join(skipped_clusters(rows, cluster, max_size).select(cluster), cluster, "left_anti")
    rows = rows.where(F.col(cluster).isNotNull() & F.col(key).isNotNull())
    dealt = tiled(rows, [cluster, "_len"], key, "_flat", tile)
    names = {"_c": cluster, "_a": "a", "_b": "b", "_rmsd": "rmsd"}

    def run(batches):
        held = None
        for batch in batches:
            now = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            starts = _starts(now)
            yield from _tile_pairs(now, starts)
            held = now.slice(starts[-1]).combine_chunks()  # a tile may go on in the next batch
        if held is not None and held.num_rows:
            yield from _tile_pairs(held, np.array([0, held.num_rows]))

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = dealt.select(F.col(cluster).alias("_c"), "_len", "_i", "_j", "_own", "_k", "_v").mapInArrow(run, f"_c {kind[cluster]}, _a {kind[key]}, _b {kind[key]}, _rmsd double")
    return found.select(*[F.col(c).alias(n) for c, n in names.items()])


#: pairs that the kernel works on, and sends, at once
STEP, SENT = 8192, 65536


def _starts(rows: pa.Table) -> np.ndarray:
    """First rows of the tiles in rows sorted by tile."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("_c", "_len", "_i", "_j"):
        code = rows.column(c).combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _tile_pairs(rows: pa.Table, starts: np.ndarray):
    """Batches of pairs and RMSDs of the tiles between one start and the next."""
    if len(starts) < 2:
        return
    key, flat = rows.column("_k").combine_chunks(), rows.column("_v").combine_chunks()
    order = pc.rank(key, tiebreaker="dense").to_numpy(zero_copy_only=False)  # as Spark compares: numbers, or bytes of strings
    length, i, j, own = (rows.column(c).to_numpy() for c in ("_len", "_i", "_j", "_own"))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def sent() -> pa.RecordBatch:
        a, b, d = (np.concatenate(x) for x in zip(*held))
        held.clear()
        a, b = np.where(order[a] < order[b], a, b), np.where(order[a] < order[b], b, a)
        return pa.RecordBatch.from_arrays([rows.column("_c").combine_chunks().take(pa.array(a)), key.take(pa.array(a)), key.take(pa.array(b)), pa.array(d)], ["_c", "_a", "_b", "_rmsd"])

    for low, high in zip(starts[:-1], starts[1:]):
        same = i[low] == j[low]
        if same and high - low < 2:
            continue
        at = np.arange(low, high)
        left, right = (at, at) if same else (at[own[low:high] == i[low]], at[own[low:high] == j[low]])
        points = flat.slice(low, high - low).flatten().to_numpy(zero_copy_only=False).reshape(high - low, length[low], 3)
        points = points - points.mean(1, keepdims=True)
        step = max(1, STEP // max(1, len(right)))
        for x in range(0, len(left), step):
            ours, theirs = left[x : x + step], right[x:] if same else right
            d = cross_rmsd(points[ours - low], points[theirs - low])
            keep = order[ours][:, None] != order[theirs][None, :]
            if same:
                keep &= ours[:, None] < theirs[None, :]
            a, b = np.nonzero(keep)
            if len(a):
                held.append((ours[a], theirs[b], d[a, b]))
                count += len(a)
            if count >= SENT:
                yield sent()
                count = 0
    if held:
        yield sent()


def unique_pairs(df: DataFrame, cluster: str, key: str, heavy: str, light: str) -> DataFrame:
    """One row, that of the least key, for each cluster and pair of chain sequences; a null chain is its own value."""
    rest = [c for c in df.columns if c not in (cluster, heavy, light)]
    found = df.groupBy(cluster, heavy, light).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return found.select(cluster, heavy, light, "_row.*").select(*df.columns)


def skipped_clusters(df: DataFrame, cluster: str, max_size: int) -> DataFrame:
    """(cluster, n) over the size limit."""
    return df.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") > max_size)


def rmsd_report(pairs: DataFrame, ranked: bool = True) -> DataFrame:
    """One row: spread of all pairs, and shares under 1 and 2; quantiles write all distances and pass over them again and again."""
    return describe(pairs, "rmsd", below=(1.0, 2.0), ranked=ranked)


def weighted_means(pairs: DataFrame, cluster: str) -> DataFrame:
    """One row: mean over pairs, mean of cluster means, share of pairs of the two largest clusters."""
    per = pairs.groupBy(cluster).agg(F.avg("rmsd").alias("m"), F.sum("rmsd").alias("s"), F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), cluster).limit(2).agg(F.sum("n").alias("top2"))
    whole = per.agg((F.sum("s") / F.sum("n")).alias("pair_weighted"), F.avg("m").alias("cluster_weighted"), F.sum("n").alias("pairs"))
    return whole.crossJoin(top).select("pair_weighted", "cluster_weighted", "pairs", (F.col("top2") / F.col("pairs")).alias("top2_share"))  # one row each


def top_by_mean(pairs: DataFrame, cluster: str, k: int = 20) -> DataFrame:
    return pairs.groupBy(cluster).agg(F.avg("rmsd").alias("mean_rmsd"), F.count("*").alias("pairs")).orderBy(F.desc("mean_rmsd"), cluster).limit(k)


#: atoms and targets of a structure that meet as they are, without cells
SMALL = 4096


def _finite(df: DataFrame, *more: str) -> DataFrame:
    at = [F.col(c).cast("double") for c in "xyz"]
    ok = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in at]
    return df.where(ok[0] & ok[1] & ok[2]).select(*more, *[c.alias(n) for c, n in zip(at, "xyz")])


def _cells(df: DataFrame, size: float, around: bool = False) -> DataFrame:
    """Add the cell of each point or, with ``around``, a row for it and each of its 26 neighbours."""
    cell = [F.col(c) / size - F.pmod(F.col(c) / size, F.lit(1.0)) for c in "xyz"]  # floors, as doubles: no coordinate is too large
    if not around:
        return df.withColumns({f"_i{c}": i for c, i in zip("xyz", cell)})
    steps = F.array(*[F.struct(*[F.lit(float(d)).alias(c) for c, d in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return df.withColumn("_step", F.explode(steps)).withColumns({f"_i{c}": i + F.col(f"_step.{c}") for c, i in zip("xyz", cell)}).drop("_step")


def _nearest(own: DataFrame, others: DataFrame, by: list[str], structure: str, size: float) -> DataFrame:
    """(by, d2): the least squared distance to a target in the cell of an atom or next to it."""
    cell = [structure, "_ix", "_iy", "_iz"]
    targets = _cells(others, size).select(*cell, *[F.col(c).alias(f"_{c}") for c in "xyz"])
    gap = [F.col(c) - F.col(f"_{c}") for c in "xyz"]
    return _cells(own, size, around=True).join(targets, cell).groupBy(*by).agg(F.min(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("d2"))


def _parted(own: DataFrame, others: DataFrame, structure: str, by: list[str]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(by, d2) of structures of at most ``SMALL`` points; atoms and targets of the others, if there are any.

    A small structure's rows are dealt once, by structure. Cells would send 27 rows for each atom.
    """
    points = own.select(structure).unionByName(others.select(structure))
    large = checkpointed(points.groupBy(structure).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(structure))
    some = not large.isEmpty()
    small = [d.join(large, structure, "left_anti") if some else d for d in (own, others)]
    gap = [F.col(c) - F.col(f"_{c}") for c in "xyz"]
    met = small[0].join(small[1].select(structure, *[F.col(c).alias(f"_{c}") for c in "xyz"]).hint("merge"), structure)
    near = met.groupBy(*by).agg(F.min(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("d2"))
    return near, (own.join(large, structure), others.join(large, structure)) if some else None


def contacts_within(atoms: DataFrame, targets: DataFrame, cut: float, structure: str = "pdb_id") -> DataFrame:
    """(structure, residue, aa, min_dist) of residues with a target atom within the cut.

    In structures of more than ``SMALL`` points, atoms meet the targets of their own and of
    neighbouring cells as wide as the cut, so a structure is dealt by cell, and pairs follow the
    cut-off, not atoms times targets.
    """
    by = [structure, "residue", "aa"]
    near, large = _parted(_finite(atoms, *by), _finite(targets, structure), structure, by)
    if large:
        near = near.unionByName(_nearest(*large, by, structure, cut * (1 + 1e-9)))
    return near.select(*by, F.sqrt("d2").alias("min_dist")).where(F.col("min_dist") <= cut)


def contact_distances(atoms: DataFrame, targets: DataFrame, structure: str = "pdb_id", cell: float = 10.0, rounds: int = 60) -> DataFrame:
    """(structure, residue columns, min_dist): nearest target atom of each residue's atoms.

    ``atoms``: structure, residue, aa, x, y, z; ``targets``: structure, x, y, z. In structures
    of more than ``SMALL`` points, atoms meet the targets of neighbouring cells. A distance below the cell's width is the nearest; residues
    without one go on with wider and wider cells, until these are as wide as the structure.
    Points without finite coordinates are left out; residues without such an atom, and
    structures without such a target, have no rows.
    """
    by = [structure, "residue", "aa"]
    near, large = _parted(_finite(atoms, *by), _finite(targets, structure), structure, by)
    whole = near.select(*by, F.sqrt("d2").alias("min_dist"))
    return whole.unionByName(_by_cells(*large, structure, by, cell, rounds)) if large else whole


def _by_cells(own: DataFrame, others: DataFrame, structure: str, by: list[str], cell: float, rounds: int) -> DataFrame:
    """(by, min_dist) by cells that widen for residues without a near target."""
    others = checkpointed(others)
    whole = own.select(structure, *"xyz", F.lit(0).alias("t")).unionByName(others.withColumn("t", F.lit(1)))
    span = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    spans = whole.groupBy(structure).agg(span.alias("_span"), F.max("t").alias("t")).where("t = 1").drop("t")
    left, done = checkpointed(own.join(spans, structure)), None
    for i in range(rounds):
        if left.isEmpty():
            break
        near = _nearest(left, others, [*by, "_span"], structure, cell).withColumn("min_dist", F.sqrt("d2"))
        sure = checkpointed(near.where((F.col("min_dist") < cell * (1 - 1e-9)) | (F.col("_span") < cell * (1 - 1e-9))).select(*by, "min_dist"))
        done = sure if done is None else done.unionByName(sure)
        same = [left[c].eqNullSafe(sure[c]) for c in by]
        left = checkpointed(left.join(sure, same[0] & same[1] & same[2], "left_anti"))
        cell *= 4.0 ** (i + 1)
    else:
        raise RuntimeError(f"residues are left without a nearest target after {rounds} rounds")
    return done if done is not None else left.select(*by, F.lit(None).cast("double").alias("min_dist"))


def interface_mask(distances: DataFrame, cut: float = 10.0) -> DataFrame:
    """Add ``interface``: any atom within the cut."""
    return distances.withColumn("interface", F.col("min_dist") <= cut)


def composition_by_threshold(distances: DataFrame, cuts: tuple[float, ...] = (4.5, 6.0, 8.0, 10.0)) -> DataFrame:
    """(threshold, aa, contacting, other, share of each, fold): distances once, cuts exploded."""
    rows = distances.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in cuts])))
    near = F.col("min_dist") <= F.col("threshold")
    n = rows.groupBy("threshold", "aa").agg(F.count(F.when(near, 1)).alias("contacting"), F.count(F.when(~near, 1)).alias("other"))
    total = n.groupBy("threshold").agg(F.sum("contacting").alias("_c"), F.sum("other").alias("_o"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    out = n.join(total, "threshold").withColumn("share_contacting", share("contacting", "_c")).withColumn("share_other", share("other", "_o"))
    return out.withColumn("fold", F.try_divide("share_contacting", F.nullif("share_other", F.lit(0.0)))).drop("_c", "_o")


def masked_composition(df: DataFrame, alphabet: str, *by: str, text: str = "seq", mask: str = "mask") -> DataFrame:
    """(by, scope, letter, n) of masked letters and of all."""
    scopes = F.array(F.struct(F.lit("masked").alias("scope"), R.masked_letters(F.col(text), F.col(mask), alphabet).alias("letters")), F.struct(F.lit("full").alias("scope"), F.filter(F.split(text, ""), lambda c: c.isin(*alphabet)).alias("letters")))
    rows = df.where(F.col(text).isNotNull() & F.col(mask).isNotNull()).select(*by, F.explode(scopes).alias("s"))
    return rows.select(*by, "s.scope", F.explode("s.letters").alias("letter")).groupBy(*by, "scope", "letter").agg(F.count("*").alias("n"))
