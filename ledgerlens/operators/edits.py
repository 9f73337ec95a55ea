"""Similar texts in tiles: all texts of two blocks are compared where they meet, and no candidate is shuffled.

The kernel goes through the texts of one block in order, and takes each letter's step of the edit
distance for all texts of the other block at once, in bits (Myers 1999; Hyyro 2003 for more than
64 letters). Texts that begin alike share those steps, and texts that cannot come within reach
under a beginning are left out below it. Distances are exact.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: texts of a block; steps of one text are taken for so many others at once
TILE = 16384
#: letters of the longest texts that are compared in tiles: the steps' work grows with their square
LETTERS = 512
#: bytes of the letters' places in the texts that are compared at once
PLACES = 1 << 25
#: links that a kernel holds before it sends or counts them
SENT = 65536
ONE, ALL = np.uint64(1), np.uint64(2**64 - 1)


def _places(texts: list[str], letters: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """For each letter, bits of its places in each text, ``width`` words a text."""
    held = np.zeros((len(letters), width, len(texts)), np.uint64)
    for row, t in enumerate(texts):
        at = np.arange(len(t))
        np.bitwise_or.at(held, (np.searchsorted(letters, _codes(t)), at // 64, row), ONE << (at % 64).astype(np.uint64))
    return {chr(c): bits for c, bits in zip(letters, held)}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _step(same: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rises and falls along each text after one more letter, which stands at the places ``same``."""
    ups, downs = np.empty_like(up), np.empty_like(down)
    carry_up, carry_down = ONE, None
    for w in range(len(up)):
        p, m, e = up[w], down[w], same[w]
        rest = e | m
        if carry_down is not None:
            e = e | carry_down
        x = e & p
        x += p
        x ^= p
        x |= e
        fall = p & x
        x |= p
        np.invert(x, out=x)
        x |= m
        more = w + 1 < len(up)
        next_up, next_down = (x >> np.uint64(63), fall >> np.uint64(63)) if more else (None, None)
        x <<= ONE
        x |= carry_up
        fall <<= ONE
        if carry_down is not None:
            fall |= carry_down
        np.bitwise_and(x, rest, out=downs[w])
        x |= rest
        np.invert(x, out=x)
        np.bitwise_or(x, fall, out=ups[w])
        carry_up, carry_down = next_up, next_down
    return ups, downs


def _least(up: np.ndarray, down: np.ndarray, j: int, m: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """A bound below the distances of each text to all that begin with the j letters taken so far."""
    d, rest = np.full(len(m), j, np.int32), m.astype(np.int32)
    gap = lambda: np.maximum(np.maximum(rest - np.int32(longest - j), np.int32(shortest - j) - rest), 0)
    best = d + gap()
    for i in range(int(m.max())):
        bit = np.uint64(i % 64)
        d += ((up[i // 64] >> bit) & ONE).astype(np.int32)
        d -= ((down[i // 64] >> bit) & ONE).astype(np.int32)
        rest -= 1
        np.minimum(best, d + gap(), out=best)
    return best


def near(ours: list[str], theirs: list[str], identity: float, reach: float):
    """(number of one of theirs, numbers of ours, distances) of texts within identity and reach; none may be empty."""
    if not ours or not theirs:
        return
    letters = np.unique(np.concatenate([_codes(t) for t in ours]))
    by_length, low = sorted(range(len(ours)), key=lambda x: len(ours[x])), 0
    in_order = sorted(range(len(theirs)), key=theirs.__getitem__)
    held = [theirs[x] for x in in_order]
    while low < len(ours):
        width = (len(ours[by_length[-1]]) + 63) // 64
        size = max(64, min(TILE // width**2, PLACES // (8 * width * len(letters))))
        part = np.array(by_length[low : low + size])
        for k, x, d in _near(letters, [ours[i] for i in part], held, identity, reach):
            yield in_order[k], part[x], d
        low += size


def _near(letters: np.ndarray, ours: list[str], theirs: list[str], identity: float, reach: float):
    m, n = (np.array([len(t) for t in x], np.int32) for x in (ours, theirs))
    width = int(m.max() + 63) // 64
    places = _places(ours, letters, width)
    none = np.zeros((width, len(ours)), np.uint64)
    filled = np.stack([np.where(m >= 64 * w + 64, ALL, (ONE << np.clip(m - 64 * w, 0, 63).astype(np.uint64)) - ONE) for w in range(width)])
    # by the letters of the longer text: the most edits, and the least letters of the shorter
    longer = np.arange(max(m.max(), n.max()) + 1)
    edits, least = np.floor((1 - identity) * longer + 1e-9).astype(np.int32), np.ceil(reach * longer - 1e-9).astype(np.int32)
    # for each beginning of the text at hand: rises, falls, numbers of the texts still within reach, their letters, bits and places by letter
    levels = [(np.full((width, len(ours)), ALL), none, np.arange(len(ours)), m, filled, dict(places))]
    before = ""
    for k, t in enumerate(theirs):
        shared = 0
        while shared < min(len(t), len(before)) and t[shared] == before[shared]:
            shared += 1
        del levels[shared + 1 :]
        for j in range(len(levels), len(t) + 1):
            up, down, live, size, bits, at = levels[-1]
            letter = t[j - 1]
            if letter not in at:
                at[letter] = places.get(letter, none)[:, live]
            up, down = _step(at[letter], up, down)
            if j % 4 == 0 and len(live):
                end = bisect_right(theirs, t[:j], k, key=lambda x: x[:j])  # noqa: B023
                if end - k >= 8:
                    most = np.maximum(size, np.minimum(n[k:end].max(), np.floor(size / reach + 1e-9).astype(np.int32)))
                    keep = _least(up, down, j, size, n[k:end].min(), n[k:end].max()) <= edits[most]
                    if keep.mean() < 0.75:
                        up, down, live, size, bits, at = up[:, keep], down[:, keep], live[keep], size[keep], bits[:, keep], {}
            levels.append((up, down, live, size, bits, at))
        before = t
        up, down, live, size, bits, _ = levels[-1]
        rises, falls = np.bitwise_count(up & bits), np.bitwise_count(down & bits)
        rises, falls = (x[0].astype(np.int32) if width == 1 else x.sum(0, dtype=np.int32) for x in (rises, falls))
        d, most = rises - falls + np.int32(len(t)), np.maximum(size, n[k])
        x = np.flatnonzero(d <= edits[most])
        x = x[np.minimum(size[x], n[k]) >= least[most[x]]]
        if len(x):
            yield k, live[x], d[x]


def _links(texts: list[str], left: np.ndarray, right: np.ndarray | None, asks: np.ndarray, identity: float, reach: float):
    """Arrays (one, other, distance) of links of which an end asks, each link once; ``right`` is None where a block meets itself."""
    ask, rest = left[asks[left]], left[~asks[left]]
    tasks = [(ask, ask), (rest, ask)] if right is None else [(ask, right), (rest, right[asks[right]])]
    held, count = [], 0
    for one, other in tasks:
        if len(one) and len(other):
            many, few = (one, other) if len(one) >= len(other) else (other, one)
            for k, x, d in near([texts[i] for i in many], [texts[i] for i in few], identity, reach):
                x = many[x]
                if one is other:  # both directions come
                    x, d = x[x < few[k]], d[x < few[k]]
                held.append((x, np.full(len(x), few[k]), d))
                count += len(x)
                if count >= SENT:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held, count = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _tiles(batches):
    """Tables of the rows of a tile each, of batches in order of tiles."""
    held = None
    for batch in batches:
        now = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
        i, j = now.column("_i").to_numpy(), now.column("_j").to_numpy()
        ends = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for low, high in zip([0, *ends[:-1]], ends):
            yield now.slice(low, high - low).combine_chunks()
        held = now.slice(ends[-1] if len(ends) else 0)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _in_tiles(rows: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of (table, texts, links of the tile) in each tile of two blocks of ``rows``, which have t and columns besides.

    Texts are cut in blocks by a hash; a text goes to one tile more than there are blocks beside its own.
    """
    many = rows.count()
    blocks = max(-(-many // TILE), min(8, -(-many // 512)), 1)
    own = F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")
    # more tasks than tiles, so that few tiles share one
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, blocks * (blocks + 1)))

    def each(batches):
        for tile in _tiles(batches):
            yield from run(tile)

    return dealt.repartition(tasks, "_i", "_j").sortWithinPartitions("_i", "_j").mapInArrow(each, schema)


def _meet(tile: pa.Table, asks: np.ndarray, identity: float, reach: float):
    own, i, j = (tile.column(c).to_numpy() for c in ("_own", "_i", "_j"))
    texts = tile.column("t").to_pylist()
    left, right = (np.flatnonzero(own == i[0]), None if i[0] == j[0] else np.flatnonzero(own == j[0]))
    return texts, _links(texts, left, right, asks, identity, reach)


def pairs_in_tiles(texts: DataFrame, identity: float, reach: float) -> DataFrame:
    """(a, b, identity), a < b, of different texts ``t``, at least one letter each."""

    def run(tile: pa.Table):
        texts, links = _meet(tile, np.ones(tile.num_rows, bool), identity, reach)
        order = np.empty(len(texts), int)
        order[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
        length, column = np.array([len(t) for t in texts]), tile.column("t").combine_chunks()
        for x, y, d in links:
            first = order[x] < order[y]
            share = 1 - d / np.maximum(length[x], length[y])
            yield pa.RecordBatch.from_arrays([column.take(pa.array(np.where(first, x, y))), column.take(pa.array(np.where(first, y, x))), pa.array(share)], ["a", "b", "identity"])

    return _in_tiles(texts.select("t"), run, "a string, b string, identity double")


def neighbours_in_tiles(rows: DataFrame, identity: float, reach: float) -> DataFrame:
    """(t, links, near): how many neighbours a text has, and the least of them by (d, n, t), over links of which an end ``asks``.

    ``rows`` has t, asks, d and n. A tile sends one row for each text that has a link there.
    """

    def run(tile: pa.Table):
        asks, d, n = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "d", "n"))
        texts, links = _meet(tile, asks.astype(bool), identity, reach)
        by = np.array(sorted(range(len(texts)), key=lambda x: (d[x], n[x], texts[x])))
        order = np.empty(len(texts), int)
        order[by] = np.arange(len(texts))
        count, best = np.zeros(len(texts), np.int64), np.full(len(texts), len(texts))
        for x, y, _ in links:
            for one, other in ((x, y), (y, x)):
                count += np.bincount(one, minlength=len(texts))
                np.minimum.at(best, one, order[other])
        linked = np.flatnonzero(count)
        least = by[best[linked]]
        column = tile.column("t").combine_chunks()
        for low in range(0, len(linked), 2048):
            x, y = linked[low : low + 2048], least[low : low + 2048]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(x)), pa.array(count[x]), pa.array(d[y]), pa.array(n[y]), column.take(pa.array(y))], ["t", "links", "d", "n", "x"])

    found = _in_tiles(rows.select("t", "asks", F.col("d").cast("long").alias("d"), F.col("n").cast("long").alias("n")), run, "t string, links long, d long, n long, x string")
    return found.groupBy("t").agg(F.sum("links").alias("links"), F.min(F.struct("d", "n", "x")).alias("near"))
