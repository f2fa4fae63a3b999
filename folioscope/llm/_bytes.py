"""Vectorised views of Arrow text columns: words, hashes of words, and hashes of word or byte windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that is worked on at once, in bytes; a longer text is worked on alone.
BLOCK = 4 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20_240_601))
_ODD = _U(0x9E3779B97F4A7C15)
#: Random 64-bit values of bytes and odd multipliers, for two independent hash functions.
_BYTE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def unmix(h: np.ndarray) -> np.ndarray:
    """What `mix` made these values of."""
    back = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    h = (h ^ (h >> _U(32))) * back
    h = (h ^ (h >> _U(32))) * back
    return h ^ (h >> _U(32))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row begins (one more at the end); null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(col: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `size` bytes: first row, end row, their bytes, where each row begins."""
    data, at = text_buffers(col)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and for each row which of the words is its first (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] |= ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] |= ink[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    starts = np.cumsum(size) - size
    total = int(starts[-1] + size[-1])
    pos = np.arange(total) - np.repeat(starts, size)
    power = np.ones(int(size.max()), dtype=np.uint64)
    power[1:] = _MULT[which]
    power = np.multiply.accumulate(power)
    value = _BYTE[which][data[np.repeat(begin, size) + pos]] * power[pos]
    return mix(np.add.reduceat(value, starts) + size.astype(np.uint64) * _ODD)


def gram_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n successive elements of h (length: that of h less n - 1)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * _MULT[which] + h[j : len(h) - n + 1 + j]
    return mix(out)


def byte_grams(data: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n successive bytes, by doubling: time in proportion to log n."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    piece, have, out, covered = _BYTE[which][data], 1, None, 0
    mult, left = _MULT[which], n
    power = np.array([mult], dtype=np.uint64)
    while left:
        if left & 1:
            if out is None:
                out, covered = piece, have
            else:
                m = len(data) - covered - have + 1
                out = out[:m] * power[0] + piece[covered : covered + m]
                covered += have
        left >>= 1
        if left:
            m = len(piece) - have
            piece = piece[:m] * power[0] + piece[have : have + m]
            have *= 2
            power = power * power
    return mix(out[: len(data) - n + 1])


def window_anchor(h: np.ndarray, width: int) -> np.ndarray:
    """For each `width` successive values, where the least is (the first of equal ones)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best_h, best_at, have = h, np.arange(len(h)), 1
    while have * 2 <= width:
        a, b = best_h[: len(best_h) - have], best_h[have:]
        right = b < a
        best_at = np.where(right, best_at[have:], best_at[: len(a)])
        best_h = np.where(right, b, a)
        have *= 2
    a, b = best_h[:n], best_h[width - have : width - have + n]
    return np.where(b < a, best_at[width - have : width - have + n], best_at[:n])


def runs(g: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group the windows of each row by the gram that each is anchored at, the one with the least hash.

    g: hashes of grams of `gram` units over all rows' units; bounds: where each row's units begin.  Returns for each
    run of successive windows with one anchor: its row, the anchor's unit, its first and its last window.  Whether two
    windows of equal content have equal anchors depends on nothing but that content.
    """
    z = np.zeros(0, np.int64)
    n = int(bounds[-1])
    if n < window:
        return z, z, z, z
    anchor = window_anchor(g, window - gram + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: n - window + 1]
    start = np.flatnonzero(np.arange(n - window + 1) + window <= bounds[row + 1])
    if not len(start):
        return z, z, z, z
    a, r = anchor[start], row[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return r[at], a[at], start[at], start[last]
