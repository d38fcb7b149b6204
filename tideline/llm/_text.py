"""Vectorised word spans and polynomial hashes over Arrow string columns.

A word is a maximal run of bytes other than space, TAB, LF, VT, FF and CR; in
UTF-8 those six bytes occur nowhere else, so all work is done on raw bytes.
Hashes are Rabin-Karp polynomials modulo 2**64 taken as differences of prefix
sums, so every window costs O(1) whatever its length. The odd bases are
invertible modulo 2**64, which lets a difference be shifted back to position 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomial hashes and of the mixer.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
ALT_BASE = 0xAF251AF3B0F025B5
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

#: Texts are processed in slices of about so many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1 << 20

#: What a worker keeps for its next task of the same operator; other operators drop it first.
HELD: list = []

_POWERS: dict[tuple[int, bool], np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the powers of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        factor = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), factor, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[base, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(MIX_1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX_2)
    h ^= h >> np.uint64(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of the spans [start, end) of what prefix() summed."""
    h = (sums[ends] - sums[starts]) * powers(base, len(sums), inverse=True)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(MIX_2)))


def raw_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, keep: bool = False):
    """Slices (first row, bytes, offsets from 0) of a column, of about `limit` bytes.

    A text is never cut: one longer than the limit makes a slice of its own. Unless told
    to keep them, it first drops what tokenizing has left in this worker's memory.
    """
    if not keep:
        for drop in HELD:
            drop()
    data, offsets = raw_column(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


class Words:
    """Word spans of a slice: starts, ends, doc (row in the slice), first (word offset of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.data, self.offsets, n = data, offsets, len(data)
        solid = ~IS_SPACE[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = span_hashes(prefix(data, BYTE_BASE), self.starts, self.ends, BYTE_BASE) if hashed else None

    def windows(self, width: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word, and whether it lies within one text."""
        n = len(self.starts)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n - width + 1)
        h = span_hashes(prefix(self.hash, base), at, at + width, base)
        return h, self.doc[: n - width + 1] == self.doc[width - 1 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def distinct_rows(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions of the distinct (doc, value) pairs, ordered by both."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return order[new]
