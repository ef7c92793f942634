"""Vectorised text primitives over Arrow string buffers.

All of them work on one flat ``uint8`` buffer and row offsets, so a batch costs a fixed
number of numpy passes and no Python work per word.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

#: Rows are cut into slices of about this many bytes, so temporaries stay small whatever the batch.
SLICE_BYTES = 512 << 10
#: Rows of a slice at most, so that row numbers fit 16 bits.
SLICE_ROWS = 50_000

_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow: dict[int, np.ndarray] = {}

def trim() -> None:
    """Give memory that was freed back to the system; allocators keep it otherwise, for as long as a worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lut(pred) -> np.ndarray:
    """A table of 256 booleans."""
    return np.array([bool(pred(b)) for b in range(256)])


#: Bytes of words ``[^\\x20\\x09-\\x0D]+``.
SPACELESS = lut(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text whose A-Z are lower-cased.
ALNUM = lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: First bytes of code points.
LEAD = lut(lambda b: b & 0xC0 != 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    p = _pow.get(base)
    if p is None or len(p) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        p = np.empty(size, np.uint64)
        p[0] = 1
        have = 1
        while have < size:
            step = np.uint64(pow(base, have, 1 << 64))
            p[have : 2 * have] = p[:have] * step
            have *= 2
        _pow[base] = p
    return p[:n]


class Hasher:
    """Hashes of any byte ranges of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.c = np.zeros(n + 1, np.uint64)
        t = _TABLE[buf]
        t *= powers(_BASE, n)
        np.cumsum(t, out=self.c[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.c[end] - self.c[start]
        if len(start):
            h *= powers(_BASE_INV, len(self.c))[start]
        return mix(h + (end - start).astype(np.uint64) * _M2)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string array; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, row past the last) of consecutive slices; a longer row stands alone."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(n, at + SLICE_ROWS, max(at + 1, to))
        yield at, to
        at = to


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per row, the index of its first word (one more entry at the end).

    No word crosses a row's end.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ns = inside[buf]
    first, last = ns.copy(), ns.copy()
    first[1:] &= ~ns[:-1]
    last[:-1] &= ~ns[1:]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = ns[at]
    ends_at = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends_at] = ns[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word after lower-casing A-Z, and the index of each row's first (one more at the end).

    Rows of any length are taken in pieces that end outside words, so temporaries stay small; a hash
    depends on a word's bytes alone.
    """
    out, ends = [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + SLICE_BYTES)
        while to < n and inside[LOWER[buf[to - 1]]] and inside[LOWER[buf[to]]]:
            step = LOWER[buf[to : to + SLICE_BYTES]]
            gap = np.flatnonzero(~inside[step])
            to = min(n, to + (int(gap[0]) if len(gap) else len(step)))
            if len(gap):
                break
        # No word crosses a row's end either.
        cuts = offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, to, "left")]
        part = LOWER[buf[at:to]]
        starts, stops, _ = words(part, np.concatenate(([0], cuts - at, [to - at])), inside)
        out.append(Hasher(part)(starts, stops))
        ends.append(starts + at)
        at = to
    starts = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.searchsorted(starts, offs)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags in each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of each element, from the index of each row's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(k), bool)
    hit[1:] = same
    hit[:-1] |= same
    out[order] = hit
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a row, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += hashes[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    left = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= left)
    return mix(h[at]), at


def covered(at: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n elements lie in a window that starts at one of ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1) if np.ndim(width) else d.__setitem__(at, 1)
    if np.ndim(width):
        np.add.at(d, at + width, -1)
        return np.cumsum(d[:-1]) > 0
    c = np.cumsum(d)
    out = c[:n].copy()
    out[width:] -= c[: n - width]
    return out > 0
