"""An FM-index over integer sequences: suffix order, wavelet matrix, backward search, locate."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.  Each 0 is a terminator of its own: it sorts
    below all symbols and, among terminators, by position, so no comparison runs past
    the end of a sequence."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, dtype=np.int64)
        if step == 1:
            grown = np.concatenate(([0], (np.diff(sorted_rank) != 0).cumsum()))
            new[order] = grown
            rank = new
        if rank[order[-1]] == n - 1 and len(np.unique(rank)) == n:
            return order
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        # only suffixes that share their rank with another one are still open
        counts = np.bincount(rank, minlength=n)
        open_at = np.flatnonzero(counts[rank[order]] > 1)
        members = order[open_at]
        order[open_at] = members[np.argsort(key[members], kind="stable")]
        changed = np.concatenate(([True], np.diff(key[order]) != 0))
        starts = np.flatnonzero(changed)
        new = np.empty(n, dtype=np.int64)
        new[order] = starts[np.cumsum(changed) - 1]
        rank = new
        step *= 2
        if len(starts) == n:
            return order


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector with running counts per bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits = bits
        v = values
        for b in range(bits - 1, -1, -1):
            bit = (v >> b) & 1
            ones = np.zeros(len(v) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        lo = np.zeros(len(at), dtype=np.int64)
        hi = at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before that position."""
        pos, lo = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        symbol = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.levels, self.zeros):
            before = ones[pos]
            one = ones[pos + 1] > before
            symbol = symbol * 2 + one
            lo1 = ones[lo]
            pos = np.where(one, zeros + before, pos - before)
            lo = np.where(one, zeros + lo1, lo - lo1)
        return symbol, pos - lo


class FMIndex:
    """Index of sequences over 1..n_symbols that are each closed by a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16):
        self.n = len(text)
        sa = suffix_order(text)
        bwt = np.where(sa > 0, text[sa - 1], 0)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))[: n_symbols + 1]
        self.tree = WaveletMatrix(bwt.astype(np.int32), max(1, int(n_symbols).bit_length()))
        # sampled suffix positions; starts of sequences too, so that a walk never crosses a terminator
        keep = (sa % sample == 0) | (bwt == 0)
        self.sampled = np.full(self.n, -1, dtype=np.int64)
        self.sampled[keep] = sa[keep]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of equally long patterns (a row each) by backward search."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.arange(m)
        for k in range(length - 1, -1, -1):
            s = patterns[live, k]
            lo[live] = self.below[s] + self.tree.rank(s, lo[live])
            hi[live] = self.below[s] + self.tree.rank(s, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        dead = np.ones(m, dtype=bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk backwards to the next sampled one."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64)
        out = self.sampled[at]
        open_rows = np.flatnonzero(out < 0)
        while len(open_rows):
            s, before = self.tree.get(at[open_rows])
            at[open_rows] = self.below[s] + before
            steps[open_rows] += 1
            found = self.sampled[at[open_rows]]
            out[open_rows] = np.where(found >= 0, found + steps[open_rows], -1)
            open_rows = open_rows[found < 0]
        return out
