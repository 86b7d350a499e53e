"""Vectorised text kernels used inside Arrow tasks.

A chunk of texts is one UTF-8 byte array plus offsets; words, n-grams and their
64-bit hashes are computed for all texts of a chunk at once. Texts are never
cut: a chunk holds whole texts, at most ``CHUNK_BYTES`` of them unless a single
text is longer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_P = np.uint64(0x5851F42D4C957F2D)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _table(ranges) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: letters, digits and every non-ASCII character (after lower-casing A-Z)
WORD = _table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: everything but the ASCII white space
INK = ~_table([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_kept: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    """The first n powers; those of a chunk's length are kept for the next chunk."""
    p = _kept.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, 1), base, dtype=np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        p.flags.writeable = False
        if n <= CHUNK_BYTES:
            _kept[int(base)] = p
    return p[: max(n, 1)]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    arr = arr.fill_null("")
    if pa.types.is_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Consecutive row slices of a batch with about ``limit`` bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, offs = text_bytes(col)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = min(end, n)


@dataclass
class Words:
    """Words of a chunk: ``hash[i]``, bytes ``start[i]:end[i]``; text d owns ``off[d]:off[d+1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    data: np.ndarray
    text_off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def text(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def text_end(self) -> np.ndarray:
        """For each word, the word index at which its text ends."""
        return np.repeat(self.off[1:], self.counts)


def words(arr: pa.Array, table: np.ndarray = WORD, fold: np.ndarray = LOWER) -> Words:
    """Maximal runs of ``table`` bytes, with a hash of their bytes as ``fold`` maps them (A-Z lower-cased)."""
    data, toff = text_bytes(arr)
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), e, e, np.zeros(len(toff), np.int64), data, toff)
    ink = np.frombuffer(data.tobytes().translate(table.tobytes()), bool)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    edge = toff[toff < n]
    first[edge] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[edge[edge > 0] - 1] = True
    start = np.flatnonzero(ink & first)
    end = np.flatnonzero(ink & last) + 1
    off = np.searchsorted(start, toff)
    if len(start) == 0:
        return Words(np.empty(0, np.uint64), start, end, off, data, toff)
    body = np.where(table, fold.astype(np.uint64) + np.uint64(1), np.uint64(0))[data]
    # powers run on from word to word; dividing by that of a word's first byte starts each anew
    body *= powers(n)
    h = np.add.reduceat(body, start)
    h *= powers(n, _P_INVERSE)[start]
    h += (end - start).astype(np.uint64) * _M3
    return Words(mix(h), start, end, off, data, toff)


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive entries (those crossing a text's end are the caller's to mask)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    g = h[:m].copy()
    for j in range(1, n):
        g *= _P
        g += h[j : j + m]
    g += np.uint64((n + 64 * salt) * int(_M3) % (1 << 64))
    return mix(g)


def grouped_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values[off[d]:off[d+1]]`` for each d (0 where that is empty); wraps for uint64."""
    c = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def sequence_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence."""
    pos = (np.arange(len(w.hash)) - np.repeat(w.off[:-1], w.counts)).astype(np.uint64)
    out = []
    for c in (_M3, _P):
        s = grouped_sum(mix(w.hash * c + pos * _M1), w.off)
        out.append(mix(s + w.counts.astype(np.uint64) * _M2 + c))
    return out[0], out[1]


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated integer ranges lo[i]..hi[i]-1 and the offsets of each range."""
    n = hi - lo
    off = np.concatenate(([0], np.cumsum(n)))
    return np.arange(off[-1]) - np.repeat(off[:-1] - lo, n), off


def as_long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)


def test_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's slot is set in a packed bitmap whose size is a power of two."""
    slot = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted (``np.unique`` hashes them first, which takes many times longer)."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct key, in the order of the keys, and the sum of its numbers."""
    by = np.argsort(key)
    k = key[by]
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return by[at], np.add.reduceat(n[by], at) if len(at) else n[:0]


class Directory:
    """Finds hashes in a sorted array of distinct ones: their leading bits say about where."""

    def __init__(self, sorted_keys: np.ndarray):
        bits = max(1, len(sorted_keys).bit_length())
        self.keys, self.shift = np.append(sorted_keys, ~np.uint64(0)), np.uint64(64 - bits)
        self.first = np.zeros(1 << bits, np.int32 if len(sorted_keys) < 1 << 31 else np.int64)
        np.cumsum(np.bincount((sorted_keys >> self.shift).astype(np.int64), minlength=1 << bits)[:-1], out=self.first[1:])

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each x, and whether it is there."""
        i = self.first[(x >> self.shift).astype(np.int64)].astype(np.int64)
        at = np.flatnonzero(self.keys[i] < x)
        for _ in range(16):
            if not len(at):
                break
            i[at] += 1
            at = at[self.keys[i[at]] < x[at]]
        else:
            i[at] = np.searchsorted(self.keys, x[at])
        there = (self.keys[i] == x) & (i < len(self.keys) - 1)
        i[~there] = 0
        return i, there


def find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each x in a sorted array, and whether it is there."""
    if len(sorted_keys) == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.searchsorted(sorted_keys, x)
    i[i == len(sorted_keys)] = 0
    return i, sorted_keys[i] == x
