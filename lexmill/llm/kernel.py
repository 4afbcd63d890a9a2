"""Vectorised text kernel: hashes of words, word n-grams and byte ranges of whole Arrow string columns.

Everything here runs inside Arrow batches (mapInArrow). A batch is cut into slices of a few hundred
kilobytes of whole documents, so that the work arrays stay in cache and a worker's memory doesn't depend
on the batch; a longer document is a slice of its own. Nothing is sampled or truncated. A null text
counts as an empty one; an empty text has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW: dict[int, np.ndarray] = {}

SPACES = frozenset(b" \t\n\r\x0b\x0c")
#: Token characters: anything but white space; or ASCII letters, digits and all beyond ASCII.
NONSPACE = np.array([c not in SPACES for c in range(256)])
ALNUM = np.array([chr(c).isascii() and chr(c).isalnum() or c >= 128 for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64; kept, and grown by doubling."""
    have = _POW.get(int(base))
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE + 1, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POW[int(base)] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash depend on all of its input."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of each slice of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters (U+00C0 to U+00DE)."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(after):
        b = data[after]
        out[after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += np.uint8(32)
    return out


class Tokens:
    """Token boundaries of a slice: start, end (byte positions) and first (index of each row's first token)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a token would run across two rows
        begins[cuts] = True
        ends[cuts - 1] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


class Ranges:
    """Hashes of any byte ranges of a slice, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_B, n)[:n], out=self.sums[1:])
        self.back = powers(_BINV, n)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every row and the index of each row's first. A row of fewer than n
    words, but at least one, has one gram: all of its words."""
    weights = odd_constants(n, 11)
    count = np.diff(first)
    total = len(words)
    grams = np.zeros(max(total - n + 1, 0), np.uint64)
    for j in range(n):
        grams += words[j : total - n + 1 + j] * weights[j] if len(grams) else grams
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(have)])
    keep = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], have)
    short = np.flatnonzero((count > 0) & (count < n))
    at = begin[short]
    out = np.zeros(begin[-1], np.uint64)
    whole = np.ones(begin[-1], bool)
    whole[at] = False
    out[whole] = grams[keep[whole]]
    for r, p in zip(short.tolist(), at.tolist()):
        w = words[first[r] : first[r + 1]]
        out[p] = (w * weights[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), begin


def minhash(grams: np.ndarray, begin: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Rows x multipliers signature (uint32); rows without grams get the largest value everywhere."""
    rows = np.flatnonzero(np.diff(begin))
    out = np.full((len(begin) - 1, len(multipliers)), 0xFFFFFFFF, np.uint32)
    if len(rows):
        at, buffer = begin[rows], np.empty(len(grams), np.uint64)
        low = np.empty((len(multipliers), len(rows)), np.uint64)
        for k, a in enumerate(multipliers):
            np.multiply(grams, a, out=buffer)
            np.minimum.reduceat(buffer, at, out=low[k])
        out[rows] = (low >> np.uint64(32)).T
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, 0 for rows that have none."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
