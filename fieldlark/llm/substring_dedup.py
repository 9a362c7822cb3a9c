"""Substring dedup with fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window.  The blocks
are indexed and probed with every rolling window of that length of every document: a
repeat of a whole window, wherever it starts, holds one whole block of the other copy.
Hits are extended to the windows around them, and these are compared between documents
by full-window hash; their union is the maximal exact repeat.

Documents are dealt into groups by a hash of their id, and all that is exchanged is
packed per group: sorted distinct fingerprints go out, one bit for each comes back.  So
a passage that a third of all documents share is sent once per group, not once per
document, and no pairs of documents are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import text_bytes
from fieldlark.llm.words import PLAIN, Words, mix, owner, windows, within

#: Bytes of text in a group (held by one task at a time) and of text whose fingerprints share a
#: part.  Both grow with the input up to their bounds, for there is a message per group and part.
GROUP_BYTES, MAX_GROUP_BYTES, PART_BYTES, MAX_PART_BYTES = 2 << 20, 32 << 20, 16 << 20, 128 << 20
PACKED = "part int, kind int, grp bigint, body binary, extra binary"
KEPT = "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, text string"
BLOCKS, PROBES, FULL, STATE, HITS, LATER = range(6)
_MASK = np.uint64((1 << 40) - 1)
_SECOND = np.uint64(0xA0761D6478BD642F)


def _batch(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table(
        {"part": pa.array(cols[0], pa.int32()), "kind": pa.array(cols[1], pa.int32()), "grp": pa.array(cols[2], pa.int64()), "body": pa.array(cols[3], pa.binary()), "extra": pa.array(cols[4], pa.binary())}
    )


def _pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash, from its upper 24 bits, which its fingerprint leaves out."""
    return ((h >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a group by id, those of one id by text.

    Rows come in the order in which shuffle blocks arrive, another one in each pass and each
    retry.  Word positions are passed on between the passes, so these must not depend on it;
    rows that tie in both are alike, and any order of them gives the same positions.
    """
    table = pa.table({"id": table.column("id"), "text": table.column("text").cast(pa.large_string())}).combine_chunks()
    table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
    order = np.arange(table.num_rows)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(table.column("id").to_numpy())) + 1, [table.num_rows]))
    for k in np.flatnonzero(np.diff(bounds) > 1):
        a, b = bounds[k], bounds[k + 1]
        texts = table.column("text").slice(a, b - a).to_pylist()
        order[a:b] = sorted(range(a, b), key=lambda i: (texts[i - a] is not None, texts[i - a] or ""))
    return table.take(pa.array(order)).combine_chunks()


class _Group:
    """The documents of a group with what all passes derive from them in the same way."""

    def __init__(self, table: pa.Table, window: int, parts: int):
        table = _in_order(table)
        self.ids = table.column("id")
        self.words = Words(table.column("text"), PLAIN)
        self.h, self.first = self.words.hashes(), self.words.first
        self.doc = owner(self.first)
        self.window, self.half, self.parts = window, window // 2, parts
        self.rank_of = self.ids.to_numpy()  # documents are ordered by id; rows with equal ids share a rank

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all rolling half windows, and which of them stay in one text."""
        return windows(self.h, self.half), within(self.first, self.half)

    def unique_probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct probe hashes, and for each whether two documents of the group have it."""
        x, ok = self.probes()
        at = np.flatnonzero(ok)
        x, d = x[at], self.doc[at]
        order = np.argsort(x, kind="stable")  # documents stay in order within a hash
        x, d = x[order], d[order]
        new = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        last = np.concatenate((starts[1:], [len(x)])) - 1 if len(starts) else starts
        return x[starts], d[starts] != d[last]

    def blocks(self) -> np.ndarray:
        x, ok = self.probes()
        begin = self.first[self.doc[: len(x)]]
        return np.unique(x[ok & ((np.arange(len(x)) - begin) % self.half == 0)])

    def candidates(self, hit_hashes: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold a hit half window."""
        x, ok = self.probes()
        n = self.words.n - self.window + 1
        if n <= 0 or not len(hit_hashes):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(hit_hashes, x), len(hit_hashes) - 1)
        hit = (hit_hashes[at] == x) & ok
        sums = np.concatenate(([0], np.cumsum(hit)))
        any_hit = sums[self.window - self.half + 1 : self.window - self.half + 1 + n] - sums[:n] > 0
        return np.flatnonzero(any_hit & within(self.first, self.window))

    def full(self, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes (a row each) of the full windows of ``cand``, the smallest id of
        each in the group, and per candidate the index of its hash and whether its own id is larger."""
        x = np.stack([windows(h, self.window)[cand] for h in (self.h, mix(self.h ^ _SECOND))], axis=1) if len(cand) else np.zeros((0, 2), np.uint64)
        ids = self.rank_of[self.doc[cand]].astype(np.int64)
        u, inv = _distinct(x)
        least = _least(ids, inv, len(u))
        return u, least, inv, ids > least[inv]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of two columns, sorted, and for each row the index of its own."""
    order = np.lexsort((x[:, 1], x[:, 0]))
    x, inv = x[order], np.empty(len(order), dtype=np.int64)
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    inv[order] = np.cumsum(new) - 1
    return x[new], inv


def _least(ids: np.ndarray, inv: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, inv, ids)
    return least


def _split(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(partition, lo, hi) slices of sorted hashes."""
    p = _parts(h, parts)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(p.astype(np.int64))) + 1, [len(h)])) if len(h) else np.zeros(1, int)
    return [(int(p[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _send(parts: int, window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = _Group(table, window, parts)
        rows = []
        b = g.blocks()
        for p, lo, hi in _split(b, parts):
            rows.append((p, BLOCKS, key[0].as_py(), _pack40(b[lo:hi] & _MASK), None))
        x, many = g.unique_probes()
        for p, lo, hi in _split(x, parts):
            rows.append((p, PROBES, key[0].as_py(), _pack40(x[lo:hi] & _MASK), np.packbits(many[lo:hi]).tobytes()))
        return _batch(rows)

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and kind: index the blocks of a part, stream the probes past them,
    answer each probe with one bit: is it a block that two documents have?"""
    part, blocks, index, count, asked = None, [], None, None, []

    def answers():
        rows = []
        for grp, at, where, n in asked:
            bits = np.zeros(n, dtype=bool)
            bits[where] = count[at] >= 2
            rows.append((part, HITS, grp, np.packbits(bits).tobytes(), None))
        return _batch(rows).to_batches()

    for p, kind, grp, body, extra in _by_part(batches):
        if p != part:
            if asked:
                yield from answers()
            part, blocks, index, asked = p, [], None, []
        if kind == BLOCKS:
            blocks.append(_unpack40(body))
            continue
        if index is None:
            index = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)
            count, blocks = np.zeros(len(index), dtype=np.int32), []
        x = _unpack40(body)
        many = np.unpackbits(np.frombuffer(extra, np.uint8), count=len(x))
        if len(index):
            at = np.minimum(np.searchsorted(index, x), len(index) - 1)
            where = np.flatnonzero(index[at] == x)
            at = at[where].astype(np.int32)
            np.add.at(count, at, 1 + many[where].astype(np.int32))
        else:
            at = where = np.zeros(0, np.int32)
        asked.append((grp, at, where.astype(np.int32), len(x)))
    if asked:
        yield from answers()


def _bits(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(table.column("part").to_pylist(), table.column("kind").to_pylist(), table.column("body").to_pylist())
    return {p: b for p, k, b in rows if k == kind}


def _extend(parts: int, window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _batch([])
        g = _Group(docs, window, parts)
        x, _ = g.unique_probes()
        bits = _bits(told, HITS)
        hit = np.zeros(len(x), dtype=bool)
        for p, lo, hi in _split(x, parts):
            if p in bits:
                hit[lo:hi] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=hi - lo)
        cand = g.candidates(x[hit])
        if not len(cand):
            return _batch([])
        u, least, _, _ = g.full(cand)
        grp = key[0].as_py()
        rows = [(p, FULL, grp, u[lo:hi].tobytes(), least[lo:hi].tobytes()) for p, lo, hi in _split(u[:, 0], parts)]
        flags = np.zeros(g.words.n, dtype=bool)
        flags[cand] = True
        # the candidates come back with the answers: dealt to any part, passed on as they are
        rows.append((int(grp % parts), STATE, grp, np.packbits(flags).tobytes(), None))
        return _batch(rows)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the smallest id of each full window over all groups, answered
    with one bit per window: does a smaller id than the group's own have it?"""
    part, held = None, []

    def answers():
        ids = np.concatenate([b for _, _, b in held])
        u, inv = _distinct(np.concatenate([a for _, a, _ in held]))
        later, at, rows = ids > _least(ids, inv, len(u))[inv], 0, []
        for grp, a, _ in held:
            rows.append((part, LATER, grp, np.packbits(later[at : at + len(a)]).tobytes(), None))
            at += len(a)
        return _batch(rows).to_batches()

    for p, kind, grp, body, extra in _by_part(batches):
        if p != part:
            if held:
                yield from answers()
            part, held = p, []
        if kind == STATE:
            yield from _batch([(p, STATE, grp, body, None)]).to_batches()
        else:
            held.append((grp, np.frombuffer(body, np.uint64).reshape(-1, 2), np.frombuffer(extra, np.int64)))
    if held:
        yield from answers()


def _remove(parts: int, window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        g = _Group(docs, window, parts) if docs.num_rows else None
        ids, counts, removed, texts, spans = pa.array([], pa.int64()), [], [], [], []
        if g is not None:
            gone = np.zeros(g.words.n, dtype=bool)
            state = next(iter(_bits(told, STATE).values()), None)
            if state is not None:
                cand = np.flatnonzero(np.unpackbits(np.frombuffer(state, np.uint8), count=g.words.n))
                u, _, inv, own = g.full(cand)
                bits, later = _bits(told, LATER), np.zeros(len(u), dtype=bool)
                for p, lo, hi in _split(u[:, 0], parts):
                    if p in bits:
                        later[lo:hi] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=hi - lo)
                start = cand[later[inv] | own]
                marks = np.zeros(g.words.n + 1, dtype=np.int32)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + window, -1)
                gone = np.cumsum(marks[:-1]) > 0
            sums = np.concatenate(([0], np.cumsum(gone)))
            ids = g.ids
            for i in range(docs.num_rows):
                a, b = g.first[i], g.first[i + 1]
                lost = int(sums[b] - sums[a])
                words = g.words.bytes_of(i).split()
                if lost:
                    flags = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                    words = [words[k] for k in np.flatnonzero(~flags)]
                else:
                    spans.append([])
                counts.append(int(b - a))
                removed.append(lost)
                texts.append(b" ".join(words).decode())
        return _kept(ids, counts, removed, spans, texts)

    return run


def _kept(ids: pa.ChunkedArray | pa.Array, counts: list[int], removed: list[int], spans: list[list[dict]], texts: list[str]) -> pa.Table:
    return pa.table(
        {
            "id": ids,
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "text": pa.array(texts, pa.string()),
        }
    )


def _keep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) that keep all their words."""
    for b in batches:
        found = Words(b.column(1), PLAIN)
        words = [found.bytes_of(i).split() for i in range(b.num_rows)]
        yield from _kept(b.column(0), [len(w) for w in words], [0] * len(words), [[]] * len(words), [b" ".join(w).decode() for w in words]).to_batches()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document of smaller id.

    A window is ``window`` consecutive words `[^\\x20\\x09-\\x0D]+` of one document, an even
    number; windows are judged on the input.  Returns one row per document: id,
    ``n_words``, ``n_removed``, ``spans`` (removed word positions, end excluded), ``text``
    (kept words joined by one space).

    Edge cases: null, empty and blank texts have no words; texts shorter than a window keep
    all; a repeat inside one document stays; rows with equal ids do not remove each other;
    rows with a null id keep all their words and remove none of others, for they have no
    order; an empty table gives an empty table; other columns are ignored; an id that is
    no whole number is refused by the cast to bigint.  Windows are compared by 128-bit hash.

    Plan: the texts are shuffled once, by group, and this exchange is used by all three
    passes; one task holds one group or the block fingerprints of one part, which is a
    partition of its own.  Rows
    with a null id are not shuffled.
    """
    assert window >= 2 and window % 2 == 0
    total = text_bytes(docs, text_col)
    size = min(MAX_GROUP_BYTES, max(GROUP_BYTES, total // 4096))
    groups = int(max(64, -(-total // size)))
    part = min(MAX_PART_BYTES, max(PART_BYTES, total // 4096))
    parts = int(max(16, -(-total // part)))
    d = docs.where(F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sent = d.groupBy("grp").applyInArrow(_send(parts, window), PACKED)
    hits = sent.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_probe, PACKED)
    near = d.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(_extend(parts, window), PACKED)
    later = near.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_compare, PACKED)
    out = d.groupBy("grp").cogroup(later.groupBy("grp")).applyInArrow(_remove(parts, window), KEPT)
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return out.unionByName(nameless.mapInArrow(_keep_all, KEPT)).withColumnRenamed("id", id_col)
