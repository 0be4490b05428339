"""Words of whole Arrow batches as 64-bit hashes, by array operations over the bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; words never span documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text handled at a time, if no document is longer: its arrays of 8 bytes a byte stay near the cache.
PIECE = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x5851F42D4C957F2D)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE) + 1
        for k, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    """hash, start, end: of each word (byte places); first: of each document, and one more, the place of its first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def bounds(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; `between` marks the bytes that are in none."""
    word = ~between[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = off[:-1][off[:-1] < len(data)]
    start[edge] = word[edge]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = word[edge]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, off: np.ndarray) -> Words:
    start, end = bounds(data, off)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return Words(mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end, np.searchsorted(start, off))


def word_hash(word: str) -> int:
    """The hash that words() gives one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)])).hash[0])


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches_of_words(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(first row, end row, bytes, offsets, words) of pieces of a column."""
    data, off = buffers(column)
    for i, j in pieces(off, most):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield i, j, part, own, words(part, own)


def counts_of_words(column: pa.Array) -> np.ndarray:
    data, off = buffers(column)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in pieces(off):
        start, _ = bounds(data[off[i] : off[j]], own := off[i : j + 1] - off[i])
        out[i:j] = np.diff(np.searchsorted(start, own))
    return out


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside documents, and the place of each run's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    at = np.arange(len(h) - k + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[doc[at] == doc[at + k - 1]]
    return mix((sums[at + k] - sums[at]) * down[at] + np.uint64(k)), at


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its runs of k words; with fewer words, the whole sequence as one."""
    h, at = grams(w.hash, w.first, k)
    cut = np.searchsorted(at, w.first)
    out = []
    for d in range(len(w.first) - 1):
        n = w.first[d + 1] - w.first[d]
        if n >= k:
            out.append(np.unique(h[cut[d] : cut[d + 1]]))
        elif n:
            own = w.hash[w.first[d] : w.first[d + 1]]
            out.append(grams(own, np.array([0, n]), int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
