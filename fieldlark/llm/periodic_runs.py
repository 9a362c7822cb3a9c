"""Periodic runs of words by suffix automaton.

The end positions of a state of the suffix automaton are those of one repeated phrase.  Sets
of end positions are merged up the suffix links, the smaller into the larger, and two
positions that become neighbours no further apart than the state is long are the seed of a
square: the phrase follows itself, or overlaps itself, at that distance.  A seed is
extended both ways to its run.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import released, returns
from fieldlark.llm.words import PLAIN, Words, owner, windows, within

#: Bytes of text whose words are held at a time, besides a single longer text.
_CHUNK = 2 << 20
FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


class SuffixAutomaton:
    """States as columns: length, link, and where a state goes; most go one way only, the others have a dict."""

    def __init__(self, word: list[int]):
        length, link, sym, to = array("q", [0]), array("q", [-1]), array("q", [-1]), array("q", [-1])
        more: dict[int, dict[int, int]] = {}
        end = array("q", [-1])
        last = 0
        for at, c in enumerate(word):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            sym.append(-1)
            to.append(-1)
            end.append(at)
            p, last = last, new
            q = -1
            while p >= 0:
                if sym[p] == c:
                    q = to[p]
                    break
                if sym[p] < 0:
                    sym[p], to[p] = c, new
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: new}
                    elif c in ways:
                        q = ways[c]
                        break
                    else:
                        ways[c] = new
                p = link[p]
            if p < 0:
                continue
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            clone = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            sym.append(sym[q])
            to.append(to[q])
            end.append(-1)
            if q in more:
                more[clone] = dict(more[q])
            link[q] = link[new] = clone
            while p >= 0:
                if sym[p] == c:
                    if to[p] != q:
                        break
                    to[p] = clone
                else:
                    ways = more.get(p)
                    if ways is None or ways.get(c) != q:
                        break
                    ways[c] = clone
                p = link[p]
        self.length, self.link, self.end = length, link, end

    def neighbours(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(position, distance, length of the state) of ends that become neighbours
        in a state of at least ``least`` words, no further apart than that is long.

        Positions are kept negative: a state mostly adds one before all others, which is then an append.
        """
        length, link, end = self.length, self.link, self.end
        sets: dict[int, list[int]] = {}
        for v in np.argsort(-np.asarray(length), kind="stable").tolist():
            if length[v] < least:
                break
            own = sets.pop(v, None)
            if end[v] >= 0:
                x = -end[v]
                if own is None:
                    own = [x]
                else:  # a state's own end comes before those of the phrases that begin with it
                    k = bisect_left(own, x)
                    own.insert(k, x)
                    if k and x - own[k - 1] <= length[v]:
                        yield -x, x - own[k - 1], length[v]
                    if k + 1 < len(own) and own[k + 1] - x <= length[v]:
                        yield -own[k + 1], own[k + 1] - x, length[v]
            up = link[v]
            if own is None or up < 0 or length[up] < least:
                continue
            other = sets.get(up)
            if other is None:
                sets[up] = own
                continue
            if len(other) < len(own):
                own, other = other, own
            sets[up] = other
            size = length[up]
            for x in own:
                k = bisect_left(other, x)
                if k and x - other[k - 1] <= size:
                    yield -x, x - other[k - 1], size
                if k < len(other) and other[k] - x <= size:
                    yield -other[k], other[k] - x, size
                other.insert(k, x)


def _reach(w: np.ndarray, i: int, d: int, step: int) -> int:
    """The last i that is reached going by ``step`` (1 or -1) while w[i] equals w[i + d]."""
    width, n = 32, len(w) - d
    while 0 <= i < n:
        a, b = (i, min(n, i + width)) if step > 0 else (max(0, i - width + 1), i + 1)
        differ = w[a:b] != w[a + d : b + d]
        if step < 0:
            differ = differ[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i + step * k - step
        i += step * (b - a)
        width = min(2 * width, 1 << 16)
    return i - step


def _primitive(w: np.ndarray, start: int, period: int) -> bool:
    """Is ``period`` the smallest one of a stretch of at least two of it?"""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = period // p
            if np.array_equal(w[start : start + period - d], w[start + d : start + period]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def find_runs(w: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the words ``w``: maximal stretches with a
    smallest period q and a length of at least ``least`` and 2 * q, by start and period."""
    _, codes = np.unique(w, return_inverse=True)
    known: dict[int, tuple[list[int], list[int]]] = {}
    found = []
    # a run of length n repeats its first n - q words, which are at least least / 2
    for at, d, size in SuffixAutomaton(codes.tolist()).neighbours(max(1, (least + 1) // 2)):
        starts, ends = known.setdefault(d, ([], []))
        k = bisect_right(starts, at - size + 1) - 1
        if k >= 0 and ends[k] > at + d:
            continue
        a, b = _reach(codes, at, d, -1), _reach(codes, at, d, 1) + d + 1
        k = bisect_left(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)
        if b - a >= max(least, 2 * d) and _primitive(codes, a, d):
            found.append((a, b - a, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def segments(h: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of ``h`` that can hold a run; runs lie in one stretch whole.

    Every word of a run of length n and period q is in one of two copies of n - q words, so in a
    phrase of ``least`` / 2 words that comes twice in its stretch.  Stretches of other words
    part the text, and what is left is looked at again until nothing parts.
    """
    gram = max(1, (least + 1) // 2)
    at, part = np.arange(len(h)), doc.astype(np.int64)
    while len(at) >= least:
        g = windows(h[at], gram)
        whole = part[: len(g)] == part[gram - 1 :]
        g = g[whole] ^ (part[: len(whole)][whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks = np.zeros(len(at) + 1, dtype=np.int64)
        first = np.flatnonzero(whole)[twice]
        np.add.at(marks, first, 1)
        np.add.at(marks, first + gram, -1)
        stay = np.cumsum(marks[:-1]) > 0
        new = at[stay]
        if not len(new):
            return []
        cut = np.ones(len(new), dtype=bool)
        cut[1:] = (np.diff(new) != 1) | (np.diff(part[stay]) != 0)
        labels = np.cumsum(cut) - 1
        large = np.bincount(labels) >= least
        keep = large[labels]
        if len(new) == len(at) and keep.all() and labels[-1] == len(np.unique(part)) - 1:
            bounds = np.append(np.flatnonzero(cut), len(new))
            return [(int(new[a]), int(new[b - 1]) + 1) for a, b in zip(bounds[:-1], bounds[1:])]
        at, part = new[keep], labels[keep]
    return []


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _CHUNK, "right")))
        yield lo, hi
        lo = hi


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Per text its kept words, joined by one space."""
    size = np.where(keep, w.ends - w.starts + 1, 0)
    total = np.concatenate(([0], np.cumsum(size)))
    out = np.full(total[-1], 32, dtype=np.uint8)
    s, e, to = w.starts[keep], w.ends[keep], total[:-1][keep]
    n = e - s
    # bytes of a word go from s to its place; a space is left behind each
    shift = np.repeat(to - s, n)
    src = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out[src + shift] = w.data[src]
    bounds = total[w.first]
    data = out.tobytes()
    return pa.array([data[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


def _search(least: int, extra: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for lo, hi in _slices(batch.column(extra)):
                w = Words(batch.column(extra).slice(lo, hi - lo), PLAIN)
                h, doc = w.hashes(), owner(w.first)
                runs: list[list[dict]] = [[] for _ in range(hi - lo)]
                marks = np.zeros(w.n + 1, dtype=np.int64)
                for a, b in segments(h, doc, least):
                    i = int(doc[a])
                    for start, length, period in find_runs(h[a:b], least):
                        runs[i].append({"start": a + start - int(w.first[i]), "length": length, "period": period})
                        marks[a + start + period] += 1
                        marks[a + start + length] -= 1
                text = _joined(w, np.cumsum(marks[:-1]) == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:extra]), pa.array(w.counts(), pa.int64()), pa.array(runs, kind), text], names=[*batch.schema.names[:extra], "n_words", "runs", "text"]
                )

    return run


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: int = 12) -> DataFrame:
    """Runs of repeating words of every text, and the text with each run cut to its first period.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  A run is a stretch of words with smallest
    period q and length >= max(``least``, 2 * q) that no neighbouring word extends keeping
    period q.  Returns the columns ``keep``, ``n_words``, ``runs`` (start, length, period;
    by start, then period) and ``text``: the words that no run contains after its first q,
    joined by one space.

    Edge cases: null, empty and blank texts have no words, no runs and an empty text; a text
    is searched whole, whatever its length; repeated rows, rows that share an id or have none are
    searched each; an empty table gives an empty table; other columns are ignored.

    Plan: no shuffle.  Words are compared by 64-bit hash.  Stretches without a phrase of
    ``least`` / 2 words that comes twice in them cannot hold a run and are left out at array
    speed; the rest goes through a suffix automaton each, whose memory is in proportion to
    the stretch.
    """
    d = docs.select(*keep, F.col(text_col).alias("_text"))
    return d.mapInArrow(released(_search(least, len(keep))), returns(FOUND, **{c: d.schema[c].dataType for c in keep}))
