"""Best-fit packing by bin completion.

Texts become token ids, an end id is added, and longer ones are cut into pieces of the
sequence length. Only the number of pieces of each length (at most ``capacity`` numbers)
reaches the driver, where packing is solved on these multiplicities: bin completion fills a
sequence around the largest piece left, enumerates all fillings that no other dominates (as
they are needed), tries each as often as the counts allow and then less often, and prunes by
the waste that an improvement may still have. Best-fit decreasing gives the first incumbent,
and every better end replaces it. The search stops at the lower bound or at its budget, which
grows with the number of lengths; then the best plan so far stands.

The plan is a short list of patterns with multiplicities. A piece's rank among pieces of
its length (counted in parts whose number follows the length's pieces, so one with a third
of all pieces is spread) selects its pattern, sequence and offset.

Defined results: null text is empty and has the end id alone; repeated rows are packed
once each; equal pieces are interchangeable and ranked by id; an empty table stays empty;
very long texts are cut into many pieces, none is dropped; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: nodes before the search stops, where four for each length are not more; lengths tried for a node
NODES = 3_000
TRIES = 200
#: pieces of one length that a task ranks, about, where the root of all pieces is not more
PART_ROWS = 256
#: words remembered by a worker, some 100 MB
CACHE = 400_000

_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: signs at the end of a word, from after its last letter or digit; none is an apostrophe
_LAST_SIGNS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-z0-9ß-öø-ÿ].)[!-&(-/:-@\[-`{-~]*(?=\s|\Z)")


class _Numbers(dict):
    """Words and their numbers; one that is not known yet gets the next, and is kept in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordCoder:
    """Token ids of texts, one word at a time, remembering words.

    The tokenizer lowers letters, cuts a text into runs (letters, one digit, other signs),
    drops white space and never joins runs, so words can be encoded apart. Texts of common
    letters are cut at white space and before a word's last signs, so that most words are one
    run; a new one is cut into runs in the tokenizer's way, and these go to its model, spelled
    as its byte level does. Of other texts, white-space words that have other characters or
    control strings are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _encode(self, word: str) -> list[int]:
        """The ids of a word; of one marked by a first zero, as the tokenizer has it."""
        if word[0] == "\0":
            return self.tokenizer.encode(word[1:], add_special_tokens=False).ids
        runs = (word,) if word.isalpha() else _RUNS.findall(word)
        return [t.id for run in runs for t in self.model.tokenize(run if run.isascii() else run.translate(self.spelled))]

    def _learn(self) -> None:
        """Encode the words that have got a number since the last call."""
        coded = list(map(self._encode, self.known.new))
        self.known.new.clear()
        n = len(self.known)
        at = n - len(coded)
        if n > len(self.offset):
            more = np.zeros(max(n, 2 * len(self.offset)) - len(self.offset), np.int64)
            self.offset, self.length = np.concatenate([self.offset, more]), np.concatenate([self.length, more])
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(length.sum())
        self.length[at:n], self.offset[at:n] = length, self.used + np.cumsum(length) - length
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + total] = [i for ids in coded for i in ids]
        self.used += total

    @staticmethod
    def words_of(text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _LAST_SIGNS.sub(r" \g<0>", text.lower()).split()
        out: list[str] = []
        for word in text.encode().split():  # ASCII white space only
            s = word.decode()
            if "<|" not in s and _PLAIN.fullmatch(s):
                out += _LAST_SIGNS.sub(r" \g<0>", s.lower()).split()
            else:
                out.append("\0" + s)
        return out

    def encode(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        """The ids of each text with the end id."""
        for i in range(0, len(texts), 64):
            cut = [self.words_of(t) for t in texts[i : i + 64]]
            if len(self.known) > CACHE:
                self._reset()
            numbers = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in cut]
            if self.known.new:
                self._learn()
            for at in numbers:
                length = self.length[at]
                total = int(length.sum())
                out = np.empty(total + 1, np.uint32)
                out[:total] = self.flat[np.repeat(self.offset[at] - (np.cumsum(length) - length), length) + np.arange(total)]
                out[total] = end
                yield out


_CODERS: dict[str, WordCoder] = {}


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 1, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless turned off, the ids themselves."""

    def run(batches):
        coder = _CODERS.get(tokenizer) or _CODERS.setdefault(tokenizer, WordCoder(tokenizer))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows: list[list] = [[], [], [], [], [], []]
                for key, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist(), end)):
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity].astype("<u4")
                        for col, v in zip(rows, (key, n, start, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)):
                            col.append(v)
                cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:5]]]
                if with_ids:
                    cols.append(pa.array(rows[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer: total size, and pieces of more than half that no other can join."""
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for k in {0, *(np.flatnonzero(counts[: capacity // 2 + 1]).tolist())}:
        large = int(counts[capacity - k + 1 :].sum())
        middle = slice(capacity // 2 + 1, capacity - k + 1)
        half = int(counts[middle].sum())
        room = half * capacity - int((counts[middle] * size[middle]).sum())
        small = int((counts[k : capacity // 2 + 1] * size[k : capacity // 2 + 1]).sum())
        best = max(best, large + half + max(0, -(-(small - room) // capacity)))
    return best


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on multiplicities: equal sequences are filled together."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                fit = capacity // size
                full, rest = divmod(left, fit)
                groups = [((size,) * fit, full)] * (full > 0) + [((size,) * rest, 1)] * (rest > 0)
                left = 0
            else:
                room = rooms[at]
                pattern, many = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
                take = min(many, left)
                groups = [((*pattern, size), take)] + [(pattern, many - take)] * (many > take)
                left -= take
            for pattern, many in groups:
                room = capacity - sum(pattern)
                if room not in by_room:
                    by_room[room] = []
                    rooms.insert(bisect_right(rooms, room), room)
                by_room[room].append([pattern, many])
    return [(tuple(p), m) for groups in by_room.values() for p, m in groups]


def _dominated(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether the pieces of b fit, some together, into places of the sizes of a."""
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        for j in range(len(room)):
            if room[j] >= b[i] and room[j] not in room[:j]:
                room[j] -= b[i]
                if place(i + 1):
                    return True
                room[j] += b[i]
        return False

    return len(b) >= len(a) and a != b and place(0)


def _spread(bits: int, by: int) -> int:
    """Bits at every place up to ``by`` above a set one."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits, done = bits | bits << step, done + step
    return bits


class Pool:
    """The pieces left in a search: counts by length, and bits of the lengths that are left.

    One pool serves a whole search: a node takes its pieces, and gives them back when the
    search returns, so open nodes hold no counts of their own.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = [int(c) for c in counts]
        self.bits = sum(1 << s for s, c in enumerate(self.counts) if c > 0 and s)

    def add(self, size: int, many: int) -> None:
        self.counts[size] += many
        if self.counts[size]:
            self.bits |= 1 << size
        else:
            self.bits &= ~(1 << size)

    def largest(self, most: int) -> int:
        """The largest length left up to this, or 0."""
        return (self.bits & ((1 << most + 1) - 1)).bit_length() - 1 if self.bits & ((1 << most + 1) - 1) else 0

    def reach(self, room: int) -> dict[int, int]:
        """For each length, as bits: the sums of any pieces up to it, of more than there are, so only to prune."""
        out, bits, mask = {}, 1, (1 << room + 1) - 1
        for size in (s for s, c in enumerate(self.counts) if c > 0 and s):
            step = size
            while step <= room:
                bits |= bits << step & mask
                step *= 2
            out[size] = bits
        return out


def fillings(pool: Pool, room: int, waste: int, budget: list[int] | None = None, table: dict[int, int] | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of a room that waste at most ``waste``, fullest first, one at a time.

    One is dominated if one piece left over can take the place of some of its pieces (or of
    none) within the room. ``budget`` is lowered by each length tried, and ends it. ``table``
    is a ``reach`` of this pool or of one that it is left of. The pool must be the same
    whenever the next filling is asked for.
    """
    budget = [1 << 62] if budget is None else budget
    table = pool.reach(room) if table is None else table

    def undominated(f: list[tuple[int, int]], slack: int) -> bool:
        single, some, every = 0, 1, 1  # sums of one piece; of none or several
        spare = pool.bits & ((1 << room + 1) - 1)
        for x, many in f:
            for _ in range(many):
                some, every, single = some | (every & ~1) << x, every | every << x, single | 1 << x
            if many == pool.counts[x]:
                spare &= ~(1 << x)
        return not spare & (_spread(some, slack) | (_spread(single << 1, slack - 1) if slack else 0))

    def exact(goal: int) -> Iterator[list[tuple[int, int]]]:
        f: list[tuple[int, int]] = []  # lengths, falling, each with its number
        left, most = goal, goal
        while True:
            size = pool.largest(min(most, left)) if left else 0
            if size and table[size] >> left & 1 and budget[0] > 0:
                budget[0] -= 1
                f.append((size, min(pool.counts[size], left // size)))
                left, most = left - size * f[-1][1], size - 1
                continue
            if not left:
                yield f
            if not f or budget[0] <= 0:
                return
            size, many = f.pop()
            if many > 1:
                f.append((size, many - 1))
            left, most = left + size, size - 1

    for slack in range(min(waste, room) + 1):
        for f in exact(room - slack):
            if undominated(f, slack):
                yield tuple(x for x, many in f for _ in range(many))
        if budget[0] <= 0:
            return


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Patterns of piece lengths with multiplicities, of as few sequences as found.

    Every filling of the sequence around the largest piece is a branch, as often as the
    counts allow, then less often. The search is whole unless it ends on its budget: four
    nodes for each length (``nodes`` at least), so dives complete, and ``TRIES`` lengths for
    each. It holds one pool, the open fillings, and tables for ever fewer lengths, each for
    half as many as the one before.
    """
    counts = np.asarray(counts, np.int64)
    fixed: Plan = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    work = counts.copy()
    work[capacity] = 0
    if not work.any():
        return fixed
    total, bound = int((work * np.arange(capacity + 1)).sum()), lower_bound(work, capacity)
    best = best_fit(work, capacity)
    best_n = sum(m for _, m in best)
    if best_n == bound:
        return fixed + best
    nodes = max(nodes, 4 * int((work > 0).sum()))
    budget, pool = [nodes * TRIES], Pool(work)

    def branches(wasted: int, table: dict[int, int]) -> Iterator[tuple[dict[int, int], int]]:
        head = pool.bits.bit_length() - 1
        pool.add(head, -1)
        for f in fillings(pool, capacity - head, (best_n - 1) * capacity - total - wasted, budget, table):
            pool.add(head, 1)
            need: dict[int, int] = {}
            for size in (head, *f):
                need[size] = need.get(size, 0) + 1
            for times in range(min(pool.counts[s] // n for s, n in need.items()), 0, -1):
                yield need, times
            pool.add(head, -1)
        pool.add(head, 1)

    # of each open node: the step that led to it, the sequences and the waste so far, its table and its branches
    table = pool.reach(capacity)
    stack: list[tuple] = [(None, 0, 0, table, branches(0, table))]
    while stack and nodes > 0 and budget[0] > 0 and best_n > bound:
        step, used, wasted, table, options = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            for size, n in step[0].items() if step else ():
                pool.add(size, n * step[1])
            continue
        nodes -= 1
        need, times = option
        lost = wasted + times * (capacity - sum(s * n for s, n in need.items()))
        if (best_n - 1) * capacity - total < lost:  # more waste than an improvement may have
            continue
        for size, n in need.items():
            pool.add(size, -n * times)
        if pool.bits:
            if 2 * pool.bits.bit_count() < len(table):
                table = pool.reach(capacity)
            stack.append((option, used + times, lost, table, branches(lost, table)))
            continue
        for size, n in need.items():
            pool.add(size, n * times)
        if used + times < best_n:
            best_n = used + times
            best = [(tuple(s for s, n in need.items() for _ in range(n)), times) for need, times in [*(x[0] for x in stack[1:]), option]]
    return fixed + best


def _segments(patterns: Plan, capacity: int) -> dict[str, np.ndarray]:
    """By length and then rank: where each run of ranks goes."""
    rows, first = [], 0
    rank = np.zeros(capacity + 1, np.int64)
    for pattern, many in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, int(rank[size]), first, offset))
            rank[size] += many
            offset += size
        first += many
    rows.sort()
    size, start, seq, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    base = np.concatenate([[0], np.cumsum(rank)])[:-1]
    return {"base": base, "start": base[size] + start if len(size) else start, "seq": seq, "offset": offset}


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``cut`` is read three times, so written before."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    # a length is ranked in as many parts as its pieces need: with the root of all pieces in a part, there are as many parts at most
    parts = np.maximum(1, -(-counts // max(part_rows, math.isqrt(int(counts.sum())))))
    begin = np.concatenate([[0], np.cumsum(parts)[:-1]])
    of_length = F.get(F.split(F.lit(",".join(map(str, parts.tolist()))), ","), F.col("length").cast("int")).cast("int")  # one literal
    salt = F.pmod(F.xxhash64("doc_id", "piece"), of_length).cast("int")
    firsts = np.zeros(int(parts.sum()), np.int64)  # pieces of the same length in the parts before: a number for each length, and for each full part
    if int(parts.max()) > 1:
        large = cut.where(of_length > 1).groupBy("length", salt.alias("salt")).count()
        for length, part, n in large.toLocalIterator():
            firsts[begin[length] + part] = n
        for length in np.flatnonzero(parts > 1).tolist():
            own = firsts[begin[length] : begin[length] + parts[length]]
            own[:] = np.cumsum(own) - own
    context = cut.sparkSession.sparkContext
    shared = context.broadcast({"begin": begin, "firsts": firsts, **_segments(plan(counts, capacity, nodes), capacity)})
    columns = cut.columns
    at = columns.index("length")

    def run(batches):
        s = shared.value
        last, seen = None, 0
        for b in batches:
            length = b.column(at).to_numpy(zero_copy_only=False)
            group = s["begin"][length] + b.column(len(columns)).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(group, prepend=-1) != 0)
            place = np.arange(len(group)) - np.repeat(new, np.diff([*new, len(group)]))
            if len(group) and last == group[0]:
                place[: new[1] if len(new) > 1 else None] += seen
            if len(group):
                last, seen = group[-1], int(place[-1]) + 1
            g = s["base"][length] + s["firsts"][group] + place
            k = np.searchsorted(s["start"], g, "right") - 1
            made = [pa.array(s["seq"][k] + g - s["start"][k]), pa.array(s["offset"][k])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*columns, "sequence_id", "offset"])

    dealt = cut.withColumn("_salt", salt).repartition("length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece")
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.mapInArrow(run, schema)
