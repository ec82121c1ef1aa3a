"""Column buffers and vectorised tokenising shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer document is a piece of its own, or comes in windows.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `size` bytes."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(column: pa.Array, table: np.ndarray, again: int = 0, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Like `pieces`, but a row of over two sizes comes in several windows: (first row, end row, bytes, offsets, words again).

    Windows end before a separator of the table. Those after a row's first one begin with the last
    `again` words of the one before; the last entry tells how many.
    """
    for lo, hi, data, offsets in pieces(column, size):
        if len(data) <= 2 * size:
            yield lo, hi, data, offsets, 0
            continue
        begin = end = known = 0
        while end < len(data):
            end = _separator(data, end + size, table)
            yield lo, hi, data[begin:end], np.array([0, end - begin]), known
            begin, known = _last_words(data, begin, end, again, table)


def _separator(data: np.ndarray, at: int, table: np.ndarray) -> int:
    while at < len(data):
        found = np.flatnonzero(table[data[at : at + 65_536]] == 0)
        if len(found):
            return at + int(found[0])
        at += 65_536
    return len(data)


def _last_words(data: np.ndarray, begin: int, end: int, n: int, table: np.ndarray) -> tuple[int, int]:
    """Where the last n words of data[begin:end] begin, and how many there are of them."""
    tail = 4_096
    while n:
        at = max(begin, end - tail)
        inside = table[data[at:end]] != 0
        starts = at + np.flatnonzero(inside & ~np.concatenate(([at > begin], inside[:-1])))  # a word that the tail cuts doesn't count
        if len(starts) >= n:
            return int(starts[-n]), n
        if at == begin:
            return (int(starts[0]) if len(starts) else end), len(starts)
        tail *= 4
    return end, 0


def _table(word: np.ndarray) -> np.ndarray:
    """Byte table: 0 for separators, else the byte with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[~word] = 0
    return table


def _alnum() -> np.ndarray:
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return word


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = _table(_alnum())


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words before each row) for rows of text."""
    low = table[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


#: Steps of the powers of the inverse between two that are kept, and numbers whose sums are made at a time.
_STEP, _BLOCK = 1 << 10, 1 << 16


def _powers(factor: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, factor, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Powers:
    """Powers of the odd factor and of its inverse, made where they are used: a pickled one is empty.

    A worker keeps them as long as it lives, so of the inverse's only each _STEP-th and the first ones are.
    """

    def __init__(self):
        self.inverse = pow(int(_ODD), -1, 1 << 64)
        self.first = _powers(self.inverse, _STEP - 1)
        self.up = self.far = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def cover(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, PIECE + (1 << 16))
            self.up = _powers(int(_ODD), n)
            self.far = _powers(pow(self.inverse, _STEP, 1 << 64), n // _STEP)

    def down(self, places: np.ndarray) -> np.ndarray:
        """Powers of the inverse, for places that are covered."""
        return self.far[places // _STEP] * self.first[places % _STEP]


_powers_made = Powers()
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Sums from which `span_hash` takes the hash of any span of the odd numbers given, or that the table has for the values."""
    _powers_made.cover(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    for lo in range(0, len(values), _BLOCK):
        some = values[lo : lo + _BLOCK] if table is None else table[values[lo : lo + _BLOCK]]
        some = some * _powers_made.up[lo : lo + len(some)]
        some[:1] += sums[lo : lo + 1]
        np.cumsum(some, dtype=np.uint64, out=sums[lo + 1 : lo + 1 + len(some)])
    return sums


def prefix_hash(low: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` takes the hash of any byte span."""
    return prefix_sums(low, _BYTE)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * _powers_made.down(starts)
    return mix(h + (ends - starts).astype(np.uint64) * _MIX2)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k hashes; run i starts at i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _ODD + h[i : i + n]
    return mix(total + np.uint64(k))


def grams_within_rows(first: np.ndarray, k: int) -> np.ndarray:
    """For words counted by `first` (n+1 entries): which runs of k words stay in one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for i in range(1, k):  # a run may not reach over the first word of a row
        cut = first[1:-1] - i
        cut = cut[(cut >= 0) & (cut < n)]
        ok[cut] = False
    return ok


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by row, where row i has values[first[i]:first[i+1]]; empty rows sum to 0."""
    shape = (len(first) - 1,) + values.shape[1:]
    out = np.zeros(shape, np.float64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out
