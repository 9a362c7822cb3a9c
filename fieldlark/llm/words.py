"""Words of whole texts as arrays: boundaries, 64-bit word hashes, rolling windows.

Texts are read straight from Arrow's UTF-8 buffer.  Bytes of 0x80 and above belong
to words in both word classes used here, so classes can be tested byte by byte.
Word hashes are polynomials over the bytes modulo 2**64, then scrambled; windows
are polynomials over the scrambled words.  Bytes are hashed in chunks, so memory
stays in proportion to the chunk whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_CHUNK = 1 << 21

#: `[^\x20\x09-\x0D]+`, text unchanged
PLAIN = (np.array([c != 32 and not 9 <= c <= 13 for c in range(256)]), np.arange(256, dtype=np.uint8))
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
#: `[^\x20\x09-\x0D]+` after lower-casing A-Z
LOWER = (PLAIN[0], _low)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
FOLDED = (np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in _low]), _low)

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.empty(max(n, 1 << 16), dtype=np.uint64)
        p[0] = 1
        p[1:] = _U(base)
        np.multiply.accumulate(p, out=p)
        if len(p) > 4 * _CHUNK:
            return p[:n]
        _powers[base] = have = p
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Words:
    """Words of a column of texts.

    starts, ends: byte bounds of every word in ``data``; first: index of each
    text's first word, and the number of words at the end (n_texts + 1 entries).
    A null text has no words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, kind=PLAIN):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_string()).fill_null("")
        _, off, data = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        self.fold = kind[1]
        n = len(self.data)
        inside = kind[0][self.data]
        edge = inside.copy()  # a word starts where the byte before is outside or in another text
        edge[1:] &= ~inside[:-1]
        cuts = self.offsets[:-1]
        cuts = cuts[cuts < n]
        edge[cuts] = inside[cuts]
        self.starts = np.flatnonzero(edge)
        edge[:] = inside
        edge[:-1] &= ~inside[1:]
        cuts = self.offsets[1:]
        cuts = cuts[cuts > 0] - 1
        edge[cuts] = inside[cuts]
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out = np.empty(self.n, dtype=np.uint64)
        inverse = pow(_BYTE_BASE, -1, 1 << 64)
        values = _BYTE_VALUES[self.fold]
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + _CHUNK, "right")))
            a, b = self.starts[lo], self.ends[hi - 1]
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(values[self.data[a:b]] * _power(_BYTE_BASE, b - a), out=sums[1:])
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            out[lo:hi] = (sums[e] - sums[s]) * _power(inverse, b - a)[s]
            lo = hi
        return mix(out ^ (self.ends - self.starts).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        """The words of text i joined by one space."""
        lo, hi = self.offsets[i], self.offsets[i + 1]
        return self.data[lo:hi].tobytes()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries; starts that run over the end are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    inverse = pow(_WORD_BASE, -1, 1 << 64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        part = words[lo : hi + size - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _power(_WORD_BASE, len(part)), out=sums[1:])
        out[lo:hi] = (sums[size:] - sums[:-size]) * _power(inverse, hi - lo)
    return mix(out)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """For every window start of ``windows``: does the window stay in one text?"""
    total = int(first[-1])
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n, dtype=bool)
    marks = np.zeros(n + 1, dtype=np.int64)
    bounds = first[1:-1]
    lo, hi = np.clip(bounds - size + 1, 0, n), np.clip(bounds, 0, n)
    np.add.at(marks, lo, 1)
    np.add.at(marks, hi, -1)
    ok &= np.cumsum(marks[:-1]) == 0
    return ok


def owner(first: np.ndarray) -> np.ndarray:
    """The index of the text of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
