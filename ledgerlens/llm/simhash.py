"""Near duplicates by SimHash fingerprints and bit-sliced comparison.

Fingerprints: A-Z are lowered, words are the runs of bytes outside ASCII white space, and
every run of ``k`` words, repeats included, is hashed (XXH64 of the words joined by spaces).
A bit of the fingerprint is 1 where over half of the hashes have it.

Links: two fingerprints link where at most ``radius`` bits differ. Equal fingerprints are one
row from the start. The 64 bits are cut into ``pieces``; two that link agree in all but
``radius`` of them, so they meet in the bucket of some choice of ``pieces - radius`` pieces,
and no link is lost. There are more pieces, and so longer keys, the more fingerprints there
are: a bucket of fingerprints at random holds about ``FULL`` at most.

Comparison: in a bucket, fingerprints are stored vertically, 64 to a word: plane b has bit b
of all of them. A fingerprint meets 64 others at once: the planes are added to vertical
counters by carry-save adders, three planes at a time, and a word in which all 64 counters
have passed the radius is abandoned. What is left are the links. The bits of the bucket's key
are equal in all and are not compared.

A bucket of more than ``TILE`` is cut by hash into parts, and pairs of parts are compared, so
no task holds a large one. Of a bucket only a spanning forest of its links goes on, and
connected components come from all of them, so a group of copies does not make all its pairs.

On Spark: texts are read once and never shuffled or written; different fingerprints are
dealt by bucket; components are joins and aggregates over written tables.

Defined results: null texts and texts without words have fingerprint zero, which links like
any other; fewer words than ``k`` are hashed once, whole; repeated rows keep a row each and
share a fingerprint; a null key takes part in links and has the component of its class, null
only where no key is left in it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components

SEED = 42
BITS = 64
#: hashes whose bits are counted at once
HASHES = 1 << 15
#: fingerprints of a bucket, at random, from which there are more pieces; most tables
FULL, MOST_TABLES = 64, 70
#: most fingerprints of one side of a comparison
TILE = 2048
#: words of 64 comparisons worked on at once
CELLS = 1 << 15
#: planes between two looks at which words are to be abandoned, a multiple of three
STRIDE = 9
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """The hashes of a text's runs of k words, repeats included."""
    words = text.lower().split()  # of bytes: A-Z, and the six white space characters of ASCII
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-k])]
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]


def majority(hashes: list[int]) -> int:
    """The number whose bits are those that over half of the hashes have."""
    if not hashes:
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES):
        raw = np.array(hashes[i : i + HASHES], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            found = [majority(shingle_hashes(t.as_py().encode(), k)) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def cuts_of(pieces: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each piece."""
    at = [BITS * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:])]


def pieces_for(n: int, radius: int) -> int:
    """The fewest pieces whose buckets are not over-full at random, within ``MOST_TABLES`` tables."""
    pieces = radius + 1
    while n >> (BITS * (pieces - radius) // pieces) > FULL and comb(pieces + 1, radius) <= MOST_TABLES:
        pieces += 1
    return pieces


def tables_of(pieces: int, radius: int) -> list[int]:
    """The mask of the key's bits of each table."""
    bits = [((1 << n) - 1) << a for a, n in cuts_of(pieces)]
    return [sum(bits[i] for i in chosen) for chosen in combinations(range(pieces), pieces - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def over(differ, left: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of many words still have a counter within the radius, and the counters beyond it.

    ``differ(plane, words)`` gives a plane's differing bits for those words; ``left`` is the
    number of words, and planes are numbered from 0 to ``differ.planes``.
    """
    alive = np.arange(left)
    beyond = differ.padding(alive)
    counters = [np.zeros(left, np.uint64) for _ in range((radius + 1).bit_length())]

    def add(weight: int, carry: np.ndarray) -> np.ndarray:
        """Add a plane at a power of two; what does not fit any more is beyond the radius."""
        for i in range(weight, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        return carry

    for i in range(0, differ.planes, 3):
        a, b, c = (differ(p, alive) if p < differ.planes else np.zeros(len(alive), np.uint64) for p in range(i, i + 3))
        half = a ^ b
        beyond |= add(0, half ^ c) | add(1, (a & b) | (half & c))  # the carry-save adder's sum and carry
        # counters above the radius: the first differing bit from the top decides
        above, equal = np.zeros(len(alive), np.uint64), np.full(len(alive), ONES)
        for w in range(len(counters) - 1, -1, -1):
            if radius >> w & 1:
                equal = equal & counters[w]
            else:
                above, equal = above | (equal & counters[w]), equal & ~counters[w]
        beyond |= above
        if i % STRIDE == STRIDE - 3:
            keep = np.flatnonzero(beyond != ONES)
            if len(keep) < len(alive):
                alive, beyond, counters = alive[keep], beyond[keep], [x[keep] for x in counters]
            if not len(alive):
                break
    keep = beyond != ONES
    return alive[keep], beyond[keep]


class Planes:
    """Sides of some buckets: queries, and the bit planes of what they meet.

    ``query`` and ``word`` name the cells: each is one query and one word of 64 lanes.
    """

    def __init__(self, queries: np.ndarray, lanes: np.ndarray, query: np.ndarray, word: np.ndarray, pad: np.ndarray, bits: list[int]) -> None:
        self.bits, self.planes = bits, len(bits)
        self.queries, self.query, self.word, self.pad = queries, query, word, pad
        each = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # word, lane, bit
        turned = np.packbits(each.transpose(2, 0, 1)[bits], axis=2, bitorder="little")  # plane, word, bytes of 64 lanes
        self.vertical = np.ascontiguousarray(turned).view("<u8")[:, :, 0]

    def padding(self, cells: np.ndarray) -> np.ndarray:
        """Lanes that are none, or that a query need not meet."""
        return self.pad[cells].copy()

    def __call__(self, plane: int, cells: np.ndarray) -> np.ndarray:
        own = (self.queries[self.query[cells]] >> np.uint64(self.bits[plane])) & np.uint64(1)
        return self.vertical[plane][self.word[cells]] ^ (np.uint64(0) - own)


def linked(fp: np.ndarray, side: np.ndarray, bucket: np.ndarray, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that link, of rows sorted by bucket and side.

    In a bucket of one side every pair is compared, in one of two those of both sides.
    """
    n = len(fp)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [n]])
    both = np.add.reduceat(side, starts) if n else starts  # rows of the second side
    firsts = np.where(both > 0, ends - both, ends)  # the queries are starts:firsts
    lanes_at = np.where(both > 0, firsts, starts)
    two = both > 0
    keep = (ends - lanes_at > 0) & (firsts - starts > 0) & (two | (ends - starts > 1)) & ~(two & (firsts == starts))
    starts, ends, firsts, lanes_at, two = (x[keep] for x in (starts, ends, firsts, lanes_at, two))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = -(-(ends - lanes_at) // 64)
    word_base = np.cumsum(words) - words
    # lanes: the rows of each word, -1 where there is none
    lane_row = np.full(int(words.sum()) * 64, -1, np.int64)
    size = ends - lanes_at
    flat = np.repeat(lanes_at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    lane_row[np.repeat(word_base * 64 - lanes_at, size) + flat] = flat
    lanes = np.where(lane_row >= 0, fp[lane_row], np.uint64(0))
    asked = firsts - starts
    found_a, found_b = [], []
    # cells: every query of a bucket with every word of it, some buckets at a time
    per = asked * words
    cut = np.cumsum(per) // CELLS
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(cut)) + 1):
        count = per[part]
        which = np.repeat(part, count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        query, word = starts[which] + place // words[which], word_base[which] + place % words[which]
        # a query of a single side meets the later lanes only
        row = lane_row.reshape(-1, 64)
        last = row.max(1)[word]
        useful = two[which] | (last > query)
        query, word, one = query[useful], word[useful], ~two[which][useful]
        for i in range(0, len(query), CELLS):
            q, w, alone = query[i : i + CELLS], word[i : i + CELLS], one[i : i + CELLS]
            none = (row[w] < 0) | (alone[:, None] & (row[w] <= q[:, None]))
            pad = np.packbits(none, axis=1, bitorder="little").view("<u8")[:, 0]
            lo, hi = int(w.min()), int(w.max()) + 1
            planes = Planes(fp, lanes[lo * 64 : hi * 64], q, w - lo, pad, bits)
            cells, beyond = over(planes, len(q), radius)
            near = np.unpackbits(np.ascontiguousarray(~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(near)
            found_a.append(q[cells[at]])
            found_b.append(row[w[cells[at]], lane])
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of every row of 0 to n that is linked to a lesser one."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _compare(radius: int, masks: list[int]):
    """Of rows sorted by table, bucket and parts: spanning links of fingerprints."""
    spare = [[b for b in range(BITS) if not m >> b & 1] for m in masks]

    def flush(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        table, key, i, j, side, fp = (whole.column(c).to_numpy() for c in ("t", "key", "i", "j", "side", "fp"))
        for t in np.unique(table):
            at = np.flatnonzero(table == t)
            k, x, y, s, f = key[at], i[at], j[at], side[at].astype(np.int64), fp[at].view(np.uint64)
            new = np.ones(len(at), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            a, b = linked(f, s, np.cumsum(new), radius, spare[t])
            rows, roots = forest(a, b, len(at))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(f[rows].view(np.int64)), pa.array(f[roots].view(np.int64))], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= 4 * TILE:
                # all but the last bucket are complete
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cols = [whole.column(c).to_numpy() for c in ("t", "key", "i", "j")]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
                if len(ends):
                    yield from flush([whole.slice(0, int(ends[-1]))])
                    held, size = [whole.slice(int(ends[-1]))], whole.num_rows - int(ends[-1])
        if held:
            yield from flush(held)

    return run


def links(classes: DataFrame, scratch, radius: int = 4, pieces: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links between the different fingerprints ``fp`` that connect what is within the radius."""
    masks = tables_of(pieces or pieces_for(classes.count(), radius), radius)
    keyed = F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    dealt = classes.select("fp", keyed.alias("x")).select("fp", "x.t", "x.key")
    # a large bucket is cut into parts; every pair of parts is compared once
    large = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))
    met = dealt.join(large, ["t", "key"])
    part = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("cuts") - 1)
    met = met.withColumn("own", part).withColumn("other", F.explode(all_parts))
    met = met.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    keys = ["t", "key", "i", "j"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "side", "fp")
    return dealt.mapInArrow(_compare(radius, masks), "a long, b long").distinct()


def hexed(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similar_documents(df: DataFrame, scratch, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, pieces: int | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable by links) of each row."""
    rows = scratch.write(fingerprints(df, key, text, k), "rows")
    classes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = scratch.write(links(classes.select("fp"), scratch, radius, pieces), "links")
    label = scratch.write(components(found, scratch).select(F.col("node").alias("fp"), "component"), "label")
    named = classes.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.write(named.join(least, "component").select("fp", "component_id"), "named")
    scratch.drop_all_but("rows", "named")
    return rows.join(named, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
