"""Exact Jaccard self-join of shingle sets over a token-group matrix.

Equal sets are one class from the start. The steps after that:

1. Sampled tokens. Of each class, the tokens (hashed shingles) under a hash limit are listed;
   the limit depends on the set's size, and a set lists its tokens for every limit that a
   partner's size may have. A sketch of all documents' tokens marks hot ones, which many
   sets hold; they are known to be shared and are not dealt out.
2. Survivors. Two linked sets share all but ``1 - t`` of either one's tokens, so a set whose
   unshared sampled tokens are more than that has no link. The others keep a prefix: rare
   tokens first, just as many as must contain one shared with any linked set.
3. Groups. Survivors with the same leading shared token and nearly the same size form a
   group; a group of more than ``GROUP`` is cut by hash. The matrix holds each group's
   union of prefix tokens. Groups are first compared within themselves and with the first
   cut of the same group; what is connected then is a part of the group. Two parts are
   opened only where they are in different components, share a token of the matrix, and
   their sizes allow a link, so a large group of copies does not meet itself cut by cut.
4. Opening. Within a group, and between two parts, a set is bounded by its overlap with the
   other group's token union; only where this reaches the threshold its members are
   compared, all tokens at a time, and sets already connected are not compared again.

Links are kept as spanning edges; components come from them. No pair of a linked class is
lost, whatever the sizes: every bound above is a necessary condition.

Defined results: null or empty texts have an empty set, no links and themselves as their
component; texts of fewer words than ``k`` are one token; repeated rows share a class; an
id that occurs more than once gets one row for each occurrence; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K
from ledgerlens.llm.components import components

#: sizes from which sampling begins, and by how much the sample exceeds what may be missing
LEVELS = ((0, None), (256, 2.6), (1024, 1.7))
SKETCH_BITS = 22
SKETCH_PARTS = 64
#: most sets and, about, tokens of a group
GROUP, GROUP_TOKENS = 256, 1_000_000
#: members of a component that make it a part of its group
PART = 16


def level_of(size: int) -> int:
    """The number of the hash limit for sets of this size."""
    return max(i for i, (least, _) in enumerate(LEVELS) if size >= least)


def levels_of(size: int, t: Threshold) -> list[int]:
    """The levels at which a set meets every partner that it may link with."""
    return sorted({level_of(size), level_of(t.largest(size))})


class Threshold:
    """num/den, with the bounds that follow from it, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def limit(self, level: int) -> np.uint64:
        """Tokens up to this hash are sampled.

        A sample has far more tokens than a linked set may lack, in the mean; for it to hold
        no shared token, it would have to be smaller by more than seven standard deviations.
        """
        spare = LEVELS[level][1]
        return np.uint64(2**64 - 1) if spare is None else np.uint64(min(2**64 - 1, int(spare * (1 - self.num / self.den) * 2.0**64)))

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def largest(self, size: int) -> int:
        """The largest partner of a set of this size."""
        return size * self.den // self.num

    def missing(self, size: int) -> int:
        """So many of a set's tokens, at most, are not in a linked set."""
        return size - -(-self.num * size // self.den)


def _sketch(k: int):
    """How many sets of this task hold tokens of each bucket (up to 255), in parts."""

    def run(batches):
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.uint8), [], 0

        def add() -> None:
            found = np.bincount(np.concatenate(held), minlength=1 << SKETCH_BITS)
            found += counts
            counts[:] = np.minimum(found, 255)

        for b in batches:
            for w in K.words(b.column(0)):
                sets = [s for s in K.shingle_sets(w, k) if len(s)]
                if sets:
                    held.append((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                    size += len(held[-1])
                if size > 1 << SKETCH_BITS:
                    add()
                    held, size = [], 0
        if held:
            add()
        if counts.any():
            yield _parts_batch(counts)

    return run


def _parts_batch(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in np.split(values, SKETCH_PARTS)], pa.binary())], names=["part", "bytes"])


def _add_parts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(frame["bytes"].iloc[0]), np.int64)
    for x in frame["bytes"]:
        total += np.frombuffer(x, np.uint8)
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "bytes": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def _join_parts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(frame["bytes"].iloc[0]), np.uint8)
    for x in frame["bytes"]:
        total |= np.frombuffer(x, np.uint8)
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "bytes": [total.tobytes()]})


def _collected(each: DataFrame, combine) -> list[bytes]:
    """The combined parts in order, SKETCH_PARTS of them at most."""
    rows = each.groupBy("part").applyInPandas(combine, "part int, bytes binary")
    return [bytes(r[1]) for r in sorted(rows.toLocalIterator(), key=lambda r: r[0])]


def hot_buckets(texts: DataFrame, k: int) -> np.ndarray:
    """Bits of the sketch's buckets that hold far more tokens than the mean; 512 KB."""
    parts = _collected(texts.mapInArrow(_sketch(k), "part int, bytes binary"), _add_parts)
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in parts]) if parts else np.zeros(1 << SKETCH_BITS, np.int32)
    mean = counts.sum(dtype=np.int64) / len(counts)
    return np.packbits(counts > max(64, 4 * mean + 10 * math.sqrt(mean)))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that holds all ids, and few others: 16 bits an id, at most 16 MB.

    Past that bound it holds more others, so more rows pass; none is lost.
    """
    bits = min(27, max(12, math.ceil(math.log2(16 * max(ids.count(), 1)))))

    def run(batches):
        field = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if field.any():
            yield _parts_batch(field)

    parts = _collected(ids.mapInArrow(run, "part int, bytes binary"), _join_parts)
    return (np.frombuffer(b"".join(parts), np.uint8) if parts else np.zeros(1 << (bits - 3), np.uint8)), bits


def is_hot(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: its class."""
    if not len(s):
        return 0, 0
    one, two = K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), K.mix(s * np.uint64(3) + np.uint64(len(s))).sum()
    return int(K.signed(K.mix(np.array([one])))[0]), int(K.signed(K.mix(np.array([two])))[0])


def _classes(k: int, t: Threshold, shared_hot):
    """Each row's class, and the number of its cold sampled tokens by level."""

    def run(batches):
        bits = shared_hot.value
        for b in batches:
            sizes, ones, twos, cold = [], [], [], []
            for w in K.words(b.column(1)):
                for s in K.shingle_sets(w, k):
                    sizes.append(len(s))
                    one, two = set_hash(s)
                    ones.append(one)
                    twos.append(two)
                    rest = s[~is_hot(bits, s)] if len(s) else s
                    cold.append([int(np.searchsorted(rest, t.limit(level), "right")) if level in levels_of(len(s), t) else -1 for level in range(len(LEVELS))])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (sizes, ones, twos)], pa.array(cold, pa.list_(pa.int32()))], names=["doc_id", "n", "h1", "h2", "cold"])

    return run


def _sampled(k: int, t: Threshold, shared_hot):
    """Rows (class, level, token) for cold sampled tokens, once for a class and task."""

    def run(batches):
        bits = shared_hot.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            seen, size = set(), 0
            for w in K.words(b.column(0)):
                for s in K.shingle_sets(w, k):
                    if not len(s) or (cls := set_hash(s)[0]) in seen:
                        continue
                    seen.add(cls)
                    rest = s[~is_hot(bits, s)]
                    for level in levels_of(len(s), t):
                        cold = rest[: np.searchsorted(rest, t.limit(level), "right")]
                        cols[0].append(np.full(len(cold), cls, np.int64))
                        cols[1].append(np.full(len(cold), level, np.int8))
                        cols[2].append(cold)
                        size += len(cold)
                if size > 200_000:
                    yield _posted(cols)
                    cols, size = [[], [], []], 0
            if cols[0]:
                yield _posted(cols)

    return run


def _posted(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    c = [np.concatenate(x) for x in cols]
    return pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(K.signed(c[2]))], names=["cls", "level", "token"])


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition dealt by token: the rows whose token two classes or more hold."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    token, level, cls = (whole.column(c).to_numpy() for c in ("token", "level", "cls"))
    order = np.lexsort((cls, level, token))
    token, level, cls = token[order], level[order], cls[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (level[1:] != level[:-1])
    first = new.copy()
    first[1:] |= cls[1:] != cls[:-1]  # the same class from several tasks counts once
    number = np.cumsum(new) - 1
    held = np.bincount(number[first])
    keep = np.flatnonzero(first & (held[number] > 1))
    for i in range(0, len(keep), 100_000):
        at = keep[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(level[at]), pa.array(token[at]), pa.array(held[number[at]].astype(np.int32))], names=["cls", "level", "token", "held"])


def leveled(tokens: np.ndarray, level: int) -> np.ndarray:
    """Tokens of a level as longs that differ between levels."""
    return K.signed(K.mix(tokens ^ np.uint64(level * 0x9E3779B9)))


def _prefix(s: np.ndarray, bits: np.ndarray, level_at: np.ndarray, token: np.ndarray, held: np.ndarray, t: Threshold):
    """A set's prefix in the order unshared, cold by how many hold them, hot; and its lead."""
    hot, spare = is_hot(bits, s), t.missing(len(s))
    prefix, known, holders = [], [], []
    for level in levels_of(len(s), t):
        inside = s <= t.limit(level)
        warm, mine = s[inside & hot], level_at == level
        cold, n = token[mine], held[mine]
        alone = int(inside.sum()) - len(warm) - len(cold)
        if alone > spare:
            continue
        ranked = np.concatenate([cold[np.lexsort((cold, n))], warm])
        prefix.append(leveled(ranked[: spare + 1 - alone], level))
        known += [cold, warm]
        holders += [n, np.full(len(warm), 1 << 30, np.int64)]
    if not prefix or not sum(map(len, prefix)):
        return None
    # the leading token: least hash among tokens about as widely held as most
    all_known, all_held = np.concatenate(known), np.concatenate(holders)
    middle = np.sort(all_held)[len(all_held) // 2]
    return np.concatenate(prefix), all_known[(all_held * 2 >= middle) & (all_held <= 2 * middle)].min()


def _token_sets(k: int, shared_map):
    """(doc_id, class, tokens) of rows whose id the bitmap holds."""

    def run(batches):
        field, bits = shared_map.value
        for b in batches:
            ids = b.column(0)
            at = _places(ids.fill_null(0).to_numpy(), bits)
            keep = np.flatnonzero(((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) & ids.is_valid().to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            part = b.take(pa.array(keep))
            out: list[list] = [[], [], []]
            numbers = part.column(0).to_numpy()
            for w in K.words(part.column(1)):
                for i, s in enumerate(K.shingle_sets(w, k), w.first):
                    if len(s):
                        for col, v in zip(out, (int(numbers[i]), set_hash(s)[0], s.tobytes())):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "cls", "tokens"])

    return run


def _prefixes(t: Threshold, shared_hot):
    """Of a class's tokens and its shared cold ones: prefix and group key."""

    def run(batches):
        bits = shared_hot.value
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            shared, classes, sets = b.column("shared"), b.column("cls").to_numpy(), b.column("tokens")
            flat = shared.flatten()
            level, token, held = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in shared])
            for i in range(b.num_rows):
                raw = sets[i].as_py()
                s = np.frombuffer(raw, np.uint64)
                at = slice(ends[i - 1] if i else 0, ends[i])
                found = _prefix(s, bits, level[at], token[at].astype(np.int64).view(np.uint64), held[at].astype(np.int64), t)
                if found:
                    prefix, lead = found
                    bucket = int(math.log(len(s)) / math.log(t.den / t.num))
                    for col, v in zip(out, (int(classes[i]), int(np.array([lead], np.uint64).view(np.int64)[0]), bucket, len(s), prefix, raw)):
                        col.append(v)
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["cls", "lead", "bucket", "n", "prefix", "tokens"])

    return run


class Finder:
    """Union-find over the rows of an opening."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def open_groups(sets: list[np.ndarray], left: list[int], right: list[int], t: Threshold) -> list[tuple[int, int]]:
    """Spanning links between rows of ``left`` and of ``right`` (the same list: within it)."""
    find, edges = Finder(len(sets)), []
    hubs: dict[int, int] = {}  # of a component, a member that linked last
    right = sorted(right, key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in right])
    tokens, column = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    member = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(column, kind="stable")
    member, starts = member[order], np.searchsorted(column[order], np.arange(len(tokens) + 1))
    for q in left:
        s = sets[q]
        at = np.searchsorted(tokens, s)
        at[at == len(tokens)] = 0
        at = at[tokens[at] == s]
        if t.den * len(at) < t.num * len(s):  # the bound: overlap with the group's union
            continue
        low, high = np.searchsorted(sizes, -(-t.num * len(s) // t.den)), np.searchsorted(sizes, t.largest(len(s)), "right")
        own = find.root(q)
        open_ = [j for j in range(low, high) if right[j] != q and find.root(right[j]) != own]
        for root in {find.root(right[j]) for j in open_}:
            hub = hubs.get(root)
            if hub is not None and t.links(len(np.intersect1d(s, sets[hub], assume_unique=True)), len(s), len(sets[hub])):
                own, other = find.root(q), root
                find.up[max(own, other)] = min(own, other)
                hubs[min(own, other)] = hub
                edges.append((q, hub))
        own = find.root(q)
        open_ = [j for j in open_ if find.root(right[j]) != own]
        if not open_:
            continue
        count = starts[at + 1] - starts[at]
        flat = np.repeat(starts[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        common = np.bincount(member[flat], minlength=len(right))
        for j in open_:
            if t.links(int(common[j]), len(s), int(sizes[j])):
                a, b = find.root(q), find.root(right[j])
                if a != b:
                    find.up[max(a, b)] = min(a, b)
                    hubs[min(a, b)] = right[j]
                    edges.append((q, right[j]))
    return edges


def _open(t: Threshold):
    """Rows of one opening, dealt together: spanning edges of classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls").drop_duplicates("cls")
        sets = [np.frombuffer(x, np.uint64) for x in frame["tokens"]]
        cls, side = frame["cls"].to_numpy(), frame["side"].to_numpy()
        left, right = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
        found = open_groups(sets, left, right if right else left, t) if left else []
        return pd.DataFrame({"a": pd.Series([int(cls[i]) for i, _ in found], dtype="int64"), "b": pd.Series([int(cls[j]) for _, j in found], dtype="int64")})

    return run


def group_pairs(members: DataFrame, t: Threshold) -> DataFrame:
    """(g, h), g < h, of parts of groups that share a token of the matrix and may be linked.

    ``members``: g (part), parent (group), label (component so far), n, prefix. Parts of one
    group have been compared, and parts of one component need not be. Within a token's list
    only parts outside its largest component meet the others.
    """
    matrix = members.select("g", "parent", "label", F.explode("prefix").alias("token"), "n").groupBy("token", "g").agg(F.first("parent").alias("parent"), F.first("label").alias("label"), F.min("n").alias("low"), F.max("n").alias("high"))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        token, g, parent, label, low, high = (whole.column(c).to_numpy() for c in ("token", "g", "parent", "label", "low", "high"))
        order = np.lexsort((g, label, token))
        token, g, parent, label, low, high = (x[order] for x in (token, g, parent, label, low, high))
        bounds = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        found: set[tuple[int, int]] = set()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if label[a] == label[b - 1]:
                continue
            names, sizes = np.unique(label[a:b], return_counts=True)
            common = names[sizes.argmax()]
            for i in (np.flatnonzero(label[a:b] != common) + a).tolist():
                fit = (label[a:b] != label[i]) & (parent[a:b] != parent[i]) & (t.den * high[a:b] >= t.num * low[i]) & (t.den * high[i] >= t.num * low[a:b])
                found.update((min(int(g[i]), x), max(int(g[i]), x)) for x in g[a:b][fit].tolist())
            if len(found) > 200_000:
                yield _pairs_batch(found)
                found = set()
        if found:
            yield _pairs_batch(found)

    return matrix.repartition("token").mapInArrow(run, "g long, h long").distinct()


def _opened(members: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """Spanning edges (a, b) of the opened pairs of groups; members: g, cls, tokens."""
    one = pairs.select("g", "h", F.col("g").alias("m"), F.lit(0).alias("side"))
    two = pairs.where("g <> h").select("g", "h", F.col("h").alias("m"), F.lit(1).alias("side"))
    dealt = one.unionByName(two).join(members.withColumnRenamed("g", "m"), "m")
    return dealt.groupBy("g", "h").applyInPandas(_open(t), "a long, b long")


def _pairs_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["g", "h"])


def similar_documents(docs: DataFrame, scratch, key: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row.

    ``threshold`` is a fraction: sets link at an intersection of at least that share of the
    union. ``scratch`` holds the written tables between steps.
    """
    t = Threshold(*threshold)
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_buckets(given.select("text"), k))
    rows = scratch.write(given.mapInArrow(_classes(k, t, hot), "doc_id long, n long, h1 long, h2 long, cold array<int>"), "rows")
    # equal sets have equal counts, so any row's stand for the class
    reps = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("cold").alias("cold"))
    reps = scratch.write(reps.where("rep IS NOT NULL").select(F.col("h1").alias("cls"), "rep", "n", "cold"), "reps")

    posted = given.select("text").mapInArrow(_sampled(k, t, hot), "cls long, level byte, token long")
    listed = posted.repartition("token").mapInArrow(_shared_tokens, "cls long, level byte, token long, held int")
    shared = listed.groupBy("cls").agg(F.collect_list(F.struct("level", "token", "held")).alias("shared"))
    # a class's list is no longer than its set
    spare = F.col("n") - F.ceil(F.col("n") * t.num / t.den)
    found = lambda i: F.coalesce(F.size(F.filter("shared", lambda x: x["level"] == i)), F.lit(0))
    may_link = [(F.col("cold")[i] >= 0) & (F.col("cold")[i] - F.greatest(found(i), F.lit(0)) <= spare + 1) for i in range(len(LEVELS))]
    likely = reps.join(shared, "cls", "left").where(may_link[0] | may_link[1] | may_link[2]).select("cls", "rep", "shared")
    likely = scratch.write(likely, "likely")
    known = docs.sparkSession.sparkContext.broadcast(id_bitmap(likely.select("rep")))
    sets = given.mapInArrow(_token_sets(k, known), "doc_id long, cls long, tokens binary")
    # rows of the representative's id with another text have another class
    sets = sets.join(likely.withColumnRenamed("rep", "doc_id"), ["doc_id", "cls"]).select(F.col("doc_id").alias("cls"), "tokens", "shared")
    survivors = sets.mapInArrow(_prefixes(t, hot), "cls long, lead long, bucket int, n long, prefix array<long>, tokens binary")
    survivors = scratch.write(survivors, "survivors")
    hot.destroy()
    known.destroy()

    sizes = survivors.groupBy("lead", "bucket").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("cuts")).where("cuts > 1")
    members = survivors.join(sizes, ["lead", "bucket"], "left")
    cut = F.pmod(F.xxhash64("cls"), F.coalesce("cuts", F.lit(1)))
    members = scratch.write(members.select("cls", "n", "prefix", "tokens", "lead", "bucket", F.xxhash64("lead", "bucket", cut).alias("g")), "members")
    scratch.drop("survivors", "likely")

    # first within each group, and between the first cut of a large group and the others
    alone = members.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g", F.col("g").alias("h"))
    cuts = members.select("lead", "bucket", "g").distinct()
    hubs = cuts.groupBy("lead", "bucket").agg(F.min("g").alias("hub"), F.count("*").alias("c")).where("c > 1")
    star = cuts.join(hubs, ["lead", "bucket"]).where("g <> hub").select(F.col("hub").alias("g"), F.col("g").alias("h"))
    near = scratch.write(_opened(members.select("g", "cls", "tokens"), alone.unionByName(star), t), "near")
    first = scratch.write(components(near, scratch), "first")

    # then between parts of groups that are not connected yet
    label = F.coalesce("component", "cls")
    parts = members.drop("tokens").join(first, members["cls"] == first["node"], "left").select("cls", "n", "prefix", F.col("g").alias("parent"), label.alias("label"))
    # a part for each component that holds many of a group, and one for the rest of it
    many = parts.groupBy("parent", "label").agg(F.count("*").alias("c")).where(F.col("c") >= PART)
    mark = F.when(F.col("c").isNotNull(), F.col("label")).otherwise(F.xxhash64("parent", F.lit("rest")))
    parts = parts.join(many, ["parent", "label"], "left").withColumn("mark", mark).withColumn("g", F.xxhash64("parent", "mark")).drop("c")
    parts = scratch.write(parts, "parts")
    pairs = scratch.write(group_pairs(parts.drop("label").withColumnRenamed("mark", "label"), t), "pairs")
    needed = pairs.select(F.explode(F.array("g", "h")).alias("g")).distinct()
    whole = parts.select("g", "cls", "label").join(needed, "g")
    far = scratch.write(_opened(whole.join(members.select("cls", "tokens"), "cls").select("g", "cls", "tokens"), pairs, t), "far")
    scratch.drop("members", "pairs", "near")
    of = parts.select("cls", "label").distinct()
    rest = far.join(of.select(F.col("cls").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("cls").alias("b"), F.col("label").alias("lb")), "b")
    second = components(rest.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch).select(F.col("node").alias("component"), F.col("component").alias("later"))
    found = first.join(second, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    # classes that were alone until the second step
    only = second.join(first.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("later").alias("component"))
    found = found.unionByName(only)
    labels = reps.join(found, reps["rep"] == found["node"], "left").select("cls", "n", F.coalesce("component", "rep").alias("component"))
    out = rows.join(labels, (rows["h1"] == labels["cls"]) & (rows["n"] == labels["n"]), "left")
    return out.select(rows["doc_id"], rows["n"].alias("n_shingles"), F.when(rows["n"] > 0, F.col("component")).otherwise(rows["doc_id"]).alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, a repeated row once; all columns.

    ``found`` is what ``similar_documents`` returns for these rows, as a written table. Rows whose id a
    bitmap of the ids in question does not hold are kept where they are; only the others are
    dealt by id and decided exactly, so what is shuffled follows the duplicates. A null id
    stays; of an id with several texts, each text stays once.
    """
    extra = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_id")).distinct()
    repeated = found.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1 AND _id IS NOT NULL").select("_id")
    field, bits = id_bitmap(extra.unionByName(repeated))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 16 MB at most

    @F.pandas_udf("boolean")
    def in_question(ids: pd.Series) -> pd.Series:
        at = _places(ids.to_numpy(), bits)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    own = F.col(f"`{key}`").cast("long")
    asked = own.isNotNull() & in_question(F.coalesce(own, F.lit(0)))
    same = F.col(f"d.`{key}`").cast("long") == F.col("e._id")
    odd = docs.where(asked).alias("d").join(extra.alias("e"), same, "left_anti")
    once = odd.join(repeated.alias("e"), same, "left_semi").dropDuplicates([key, text])
    return docs.where(~asked).unionByName(odd.join(repeated.alias("e"), same, "left_anti")).unionByName(once)
