"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, A-Z lowered; punctuation apart) of test items and of
documents are compared. Hashed runs of ``MIN_MATCH`` words of all items are the seeds; a
document joins an item where they share seeds that cover enough of it. For each such pair,
tiling repeatedly marks the longest matches of unmarked words, found by Karp-Rabin hashes
that run again at falling lengths, until none of ``MIN_MATCH`` words is left; the share of the item's words marked is
its coverage, so passages in another order count in full.

Test items go to the tasks in blocks of at most ``BLOCK_WORDS`` words, a pass for each;
documents are never shuffled, so no item or passage makes a hot task. The cost of a text is
near linear in its words, however repetitive it is.

Defined results: null or empty texts and items match nothing; an item of fewer words than
``MIN_MATCH`` must occur whole; repeated rows give repeated results; ties between matches
go to the earliest place in the item, then in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_WORDS = 2_000_000


def word_hashes(column: pa.Array):
    """For each text, the hashes of its words without punctuation."""
    for w in K.words(column, tokens=True):
        kind = K._KIND[w.data[w.start]] if len(w.start) else np.zeros(0, np.uint8)
        keep = kind == 1
        yield w.first, w.hash[keep], np.concatenate([[0], np.cumsum(keep)])[w.bounds]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes of the runs of a text, at any length: prefix sums of powers of an odd base."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), _BASE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)])
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), _BACK)]))

    def runs(self, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of free words, and their hashes."""
        if length > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[length:] == taken[:-length])
        return at, K.mix((self.sums[at + length] - self.sums[at]) * self.back[at])


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in doc, place in item, words), longest first.

    Karp-Rabin hashes run again at ever smaller lengths: the longest match of free words is
    found by halving, since a match of a length holds matches of all smaller ones, and all
    of that length are marked. Lengths fall and each marks as many words, so there are about
    as many rounds as the root of the item's words, each linear in both texts.
    """
    a, b, tiles = Rolling(doc), Rolling(item), []
    free_a, free_b, most = np.ones(len(doc), bool), np.ones(len(item), bool), min(len(doc), len(item))

    def met(length: int):
        at_b, hash_b = b.runs(length, free_b)
        at_a, hash_a = a.runs(length, free_a)
        keep = np.isin(hash_a, hash_b)
        return at_a[keep], hash_a[keep], at_b, hash_b

    while most >= least and len(met(least)[0]):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(met(middle)[0]) else (low, middle - 1)
        at_a, hash_a, at_b, hash_b = met(low)
        order = np.argsort(hash_a, kind="stable")
        at_a, hash_a = at_a[order], hash_a[order]
        following = {}  # of a hash, the next place in the document that may still be free
        for j, h in zip(at_b.tolist(), hash_b.tolist()):
            if not free_b[j : j + low].all():
                continue
            key = np.uint64(h)
            at = following.get(h, int(np.searchsorted(hash_a, key)))
            while at < len(hash_a) and hash_a[at] == key:
                i = int(at_a[at])
                at += 1
                if free_a[i] and free_a[i + low - 1] and free_a[i : i + low].all() and (doc[i : i + low] == item[j : j + low]).all():
                    free_a[i : i + low] = free_b[j : j + low] = False
                    tiles.append((i, j, low))
                    break
            following[h] = at
        most = low - 1
    return tiles


class SeedIndex:
    """Test items and the sorted hashes of their seeds."""

    def __init__(self, ids: list[int], items: list[np.ndarray], least: int) -> None:
        self.ids, self.items, self.least = ids, items, least
        self.sizes = sorted({min(least, len(w)) for w in items if len(w)}, reverse=True)
        self.by_size = {}  # of each size of seed: the seeds in order, with their items and places
        for size in self.sizes:
            own = [n for n, w in enumerate(items) if len(w) and min(least, len(w)) == size]
            runs = [K.fold(items[n], size) for n in own]
            seeds, owner, place = np.concatenate(runs), np.repeat(own, [len(r) for r in runs]), np.concatenate([np.arange(len(r)) for r in runs])
            order = np.argsort(seeds, kind="stable")
            self.by_size[size] = seeds[order], owner[order], place[order]

    def near(self, runs: np.ndarray, size: int, coverage: float) -> list[int]:
        """The items whose words the seeds among these runs cover that much."""
        seeds, owner, place = self.by_size[size]
        asked = np.unique(runs)
        low, high = np.searchsorted(seeds, asked), np.searchsorted(seeds, asked, "right")
        count = high - low
        if not count.sum():
            return []
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        who, where = owner[at], place[at]
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        covered = np.full(len(who), size)
        same = who[1:] == who[:-1]
        covered[:-1][same] = np.minimum(size, (where[1:] - where[:-1])[same])
        total = np.bincount(who, covered)
        return [int(n) for n in np.unique(who) if total[n] >= coverage * len(self.items[n])]

    def matches(self, hashes: np.ndarray, bounds: np.ndarray, coverage: float):
        """(text, item number, tiles) of texts that reach the coverage."""
        for size in self.sizes:
            seeds = self.by_size[size][0]
            runs = K.fold(hashes, size)
            at = np.searchsorted(seeds, runs)
            at[at == len(seeds)] = 0
            hit = np.flatnonzero(seeds[at] == runs)
            text = np.searchsorted(bounds, hit, "right") - 1
            inside = hit + size <= bounds[text + 1]
            hit, text = hit[inside], text[inside]
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(hit)]):
                first = int(bounds[text[a]])
                doc, places, own = hashes[first : int(bounds[text[a] + 1])], hit[a:b] - first, runs[hit[a:b]]
                for item in self.near(own, size, coverage):
                    words = self.items[item]
                    # only words that the item's seeds cover can be in a match
                    edge = np.zeros(len(doc) + 1, np.int64)
                    of_item = places[np.isin(own, K.fold(words, size))]
                    np.add.at(edge, of_item, 1)
                    np.add.at(edge, of_item + size, -1)
                    keep = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                    gap = np.flatnonzero(np.diff(keep) > 1) + 1
                    part, back = np.insert(doc[keep], gap, np.uint64(0)), np.insert(keep, gap, -1)
                    tiles = [(int(back[i]), j, n) for i, j, n in tile(part, words, size)]
                    if sum(n for _, _, n in tiles) >= coverage * len(words):
                        yield int(text[a]), item, tiles


def _scan(index: SeedIndex, coverage: float):
    def run(batches):
        for b in batches:
            key, rows = b.column(0), []
            for first, hashes, bounds in word_hashes(b.column(1)):
                for text, item, tiles in index.matches(hashes, bounds, coverage):
                    marked, size = sum(n for _, _, n in tiles), len(index.items[item])
                    spans = [{"doc_word": i, "item_word": j, "words": n} for i, j, n in tiles]
                    rows.append((key[first + text].as_py(), index.ids[item], marked, size, marked / size, spans))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "marked_words", "item_words", "coverage", "tiles"])

    return run


def _blocks(items: DataFrame, item_key: str, text: str, block_words: int):
    """Blocks of (id, words) of at most so many words, an item at least."""
    block, held = [], 0
    for r in items.select(F.col(item_key).cast("long"), text).orderBy(item_key).toLocalIterator():
        words = np.concatenate([h for _, h, _ in word_hashes(pa.array([r[1]], pa.string()))] or [np.zeros(0, np.uint64)])
        if not len(words):
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((r[0], words))
        held += len(words)
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, marked_words long, item_words long, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that it covers, with the tiles."""
    given, out = docs.select(F.col(key).cast("long"), F.col(text)), None
    for block in _blocks(items, item_key, text, block_words):
        index = SeedIndex([i for i, _ in block], [w for _, w in block], least)
        part = given.mapInArrow(_scan(index, coverage), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that cover no test item, with all their columns; nothing is shuffled."""
    for block in _blocks(items, item_key, text, block_words):
        index = SeedIndex([i for i, _ in block], [w for _, w in block], least)
        at = docs.columns.index(text)

        def run(batches, index=index, at=at):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, hashes, bounds in word_hashes(b.column(at)):
                    for hit, _, _ in index.matches(hashes, bounds, coverage):
                        keep[first + hit] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
