"""Vectorised text kernels on Arrow string buffers: words, shingles and hashes.

Words are the runs of bytes outside ASCII white space, with A-Z lowered. Hashes are 64 bits
wide and depend on the bytes alone, so they are equal on all machines. Texts are worked on
in slices of about SLICE bytes, always whole texts, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: for tokens: white space 0, ASCII punctuation 2, all other bytes 1
_KIND = np.ones(256, np.uint8)
_KIND[_SPACE] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_WORD = (~_SPACE).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = mix(np.arange(1, _PLACES + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Words:
    """The words of some texts, in order."""

    first: int  # the first text's row
    count: int  # texts
    text: np.ndarray  # of each word, its text's place from ``first``
    hash: np.ndarray
    start: np.ndarray  # byte offsets in ``data``
    stop: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]
    data: np.ndarray


def words(column: pa.Array, size: int = SLICE, tokens: bool = False) -> Iterator[Words]:
    """The words of every text of a string column; a null text has none.

    With ``tokens``, runs of punctuation and runs of other bytes are words of their own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield _slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, _KIND if tokens else _WORD)
        i = j


def _slice(data: np.ndarray, offsets: np.ndarray, first: int, kinds: np.ndarray) -> Words:
    low, count = _LOWER[data], len(offsets) - 1
    kind = kinds[data]
    inside = kind > 0
    new = inside.copy()
    new[1:] &= kind[1:] != kind[:-1]
    heads = offsets[:-1][(offsets[:-1] < offsets[1:])]
    new[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= kind[1:] != kind[:-1]
    tails = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    end[tails] = inside[tails]
    start, stop = np.flatnonzero(new), np.flatnonzero(end) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    if len(start):
        length = stop - start
        at = np.flatnonzero(inside)
        begins = np.cumsum(length) - length
        place = np.arange(len(at)) - np.repeat(begins, length)
        value = (low[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & (_PLACES - 1)]
        value += (place.astype(np.uint64) >> np.uint64(12)) * value * _MULT
        hashed = mix(np.add.reduceat(value, begins) + length.astype(np.uint64))
    else:
        hashed = np.zeros(0, np.uint64)
    bounds = np.searchsorted(text, np.arange(count + 1))
    return Words(first, count, text, hashed, start, stop, bounds, low)


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k, one for each place where a run begins."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h = h * _MULT + hashes[j : j + n]
    return mix(h)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """For each text, its distinct hashed k-word shingles, ascending.

    A text of fewer words has one: its whole sequence. One without words has none.
    """
    all_runs, out = fold(w.hash, k), []
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        if b - a >= k:
            out.append(np.unique(all_runs[a : b - k + 1]))
        elif b > a:
            out.append(fold(w.hash[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(a: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's longs."""
    return a.view(np.int64)
