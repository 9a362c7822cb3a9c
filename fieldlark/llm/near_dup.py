"""N-gram Jaccard join by MinHash banding, with classes of near-duplicate documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import released, returns
from fieldlark.llm.words import FOLDED, Words, mix, owner, windows, within
from fieldlark.operators.components import components
from fieldlark.operators.lineage import Rounds

#: Buckets of up to so many different texts are compared pair by pair, larger ones block by block.
PAIRWISE = 16
#: n-grams in a block: an eighth of its hub's within these bounds.  A task holds two blocks.
LEAST_GRAMS, MOST_GRAMS = 64_000, 2_000_000
_CHUNK = 2 << 20
#: Links that a task lists before it passes them on.
_ROWS = 1 << 18


def plan_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with
    probability ``recall`` from at most ``max_hashes`` hash functions."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _grams(texts: pa.Array, size: int, kind=FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams in order of text, and the number of each text.  A text
    of fewer words, but not none, has one n-gram: all its words."""
    w = Words(texts, kind)
    h, n = w.hashes(), w.counts()
    ok = within(w.first, size)
    x, doc = windows(h, size)[ok], owner(w.first)[: len(ok)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([mix(np.bitwise_xor.reduce(mix(h[w.first[i] : w.first[i + 1]] + np.arange(n[i], dtype=np.uint64)))[None] + np.uint64(n[i]))[0] for i in short], dtype=np.uint64)
        x, doc = np.concatenate((x, extra)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        x, doc = x[order], doc[order]
    return x, np.bincount(doc, minlength=len(n))


def _band_hashes(x: np.ndarray, starts: np.ndarray, bands: int, rows: int, level: int) -> np.ndarray:
    """MinHash band hashes (text, band) of the n-gram hashes that begin at ``starts``."""
    rng = np.random.Generator(np.random.PCG64([level, 77]))
    flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    times = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(b * rows, b * rows + rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat((x ^ flip[r]) * times[r], starts))
        out[:, b] = acc
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    for batch in batches:
        texts = batch.column(1)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _CHUNK, "right")))
            yield [c.slice(lo, hi - lo) for c in batch.columns]
            lo = hi


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for ids, texts, prints in _slices(batches):
            x, n = _grams(texts, size)
            ends = np.cumsum(n)
            sets = [np.unique(x[e - k : e]) if k else None for e, k in zip(ends, n)]
            some = np.flatnonzero(n > 0)
            sig = [None if s is None else xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            found: list = [None] * len(n)
            if len(some):
                hashes = _band_hashes(x, (ends - n)[some], bands, rows, 0).view(np.int64)
                for i, row in zip(some, hashes):
                    found[i] = row
            yield pa.RecordBatch.from_arrays(
                [ids, prints, pa.array([0 if s is None else len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "print", "n", "sig", "bands"]
            )

    return run


def _sets(size: int, kind=FOLDED):
    def run(batches):
        for nodes, texts, _ in _slices(batches):
            x, n = _grams(texts, size, kind)
            ends = np.cumsum(n)
            sets = [np.unique(x[e - k : e]).view(np.int64) for e, k in zip(ends, n)]
            yield pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, j) with the Jaccard similarity of their full n-gram sets."""
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("i"))
    return both.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("j"))


class _Blocks:
    """Two blocks of a hub (or one, twice): the first asks, the second is indexed by n-gram."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table, threshold: float):
        lo, hi = key[1].as_py(), key[2].as_py()
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.ids, block, self.alone = table.column("node").to_numpy(), table.column("block").to_numpy(), lo == hi
        lists = table.column("grams").combine_chunks()
        self.starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        self.n, self.flat, self.threshold = np.diff(self.starts), flat, threshold
        self.asking, self.held = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        own = np.repeat(np.arange(len(self.ids)), self.n)
        at = np.flatnonzero((block == hi)[own])
        grams = flat[self.starts[0] : self.starts[-1]][at]
        by = np.argsort(grams, kind="stable")
        self.grams, self.own = grams[by], own[at][by].astype(np.int32)

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexed texts that reach the threshold with text ``i``, and their similarity."""
        x = self.flat[self.starts[i] : self.starts[i + 1]]
        lo, hi = np.searchsorted(self.grams, x, "left"), np.searchsorted(self.grams, x, "right")
        some = hi > lo
        lo, size = lo[some], (hi - lo)[some]
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        who, common = np.unique(self.own[at], return_counts=True) if 8 * len(at) < len(self.ids) else (None, np.bincount(self.own[at], minlength=len(self.ids)))
        if who is None:
            who = np.flatnonzero(common)
            common = common[who]
        j = common / (self.n[who] + len(x) - common)
        ok = (j >= self.threshold) & (who != i)
        return who[ok], j[ok]

    def count(self) -> pa.Table:
        """(a, b, n): text a has n links more (b is null), or a and b are in one class (n is null)."""
        links, up, edges = np.zeros(len(self.ids), dtype=np.int64), np.arange(len(self.ids)), []

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = int(up[r])
            return r

        for i in self.asking.tolist():
            who, _ = self.partners(i)
            if not len(who):
                continue
            links[i] += len(who)
            if not self.alone:
                links[who] += 1
            root = find(i)
            for r in {find(x) for x in np.unique(up[who]).tolist()} - {root}:
                up[r] = root
                edges.append((self.ids[i], self.ids[r]))
            up[who] = root
        some = np.flatnonzero(links)
        a, b = np.concatenate((self.ids[some], [e[0] for e in edges])), [None] * len(some) + [e[1] for e in edges]
        return pa.table([pa.array(a.astype(np.int64)), pa.array(b, pa.int64()), pa.array([*links[some].tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

    def list(self) -> pa.Table:
        """(a, b, j): every link once."""
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in self.asking.tolist():
            who, j = self.partners(i)
            if self.alone:
                who, j = who[who > i], j[who > i]
            held.append((np.minimum(self.ids[who], self.ids[i]), np.maximum(self.ids[who], self.ids[i]), j))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b", "j"])


def _held(sets: DataFrame, placed: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(hub, lo, hi, block, node, grams, more): every text once for each pair of blocks its own is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = sets.join(placed, "node").select("hub", "block", "node", "grams", *more, other.alias("other"))
    return each.select("hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "grams", *more)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9995, pairwise: int = PAIRWISE
) -> tuple[DataFrame, DataFrame]:
    """Documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Returns

    * one row per document: id, ``copy_id`` (the least id with the same n-gram set),
      ``class_id`` (the least id of its connected component of links), ``n_links`` (links
      of its text to other texts);
    * the links (a, b, j) between the ``copy_id`` of different texts, all that ``n_links``
      counts.  Those of large buckets are found when the table is read, for a group of n
      texts has up to n * (n - 1) / 2.

    Banding: bands and rows are chosen so that a pair at the threshold shares a bucket
    with probability ``recall``.  Exact copies fall together first, so a bucket holds
    different texts, numbered in a written table.  In a bucket of up to ``pairwise`` texts
    all pairs are verified.  Larger buckets that share texts make a hub; its texts are dealt
    into blocks by hash, and every two blocks meet in one task, which counts the links
    between them on the full sets through an inverted index and gives, of the classes,
    the edges that join what it has not yet joined.  So no link is lost to the size of a
    bucket, none is counted twice, and ``n_links`` is made without a row per link.

    Edge cases: texts without words (null, empty, blank) are no copies of each other and
    have no links; a text of fewer words than ``size`` has one n-gram; rows with equal ids
    and different texts are judged each by its own text; a text whose rows
    have no id is linked like any other, its ``copy_id`` is null, and so is the ``class_id`` of a
    class without any id; ids of any type that can be ordered are kept as they are; an empty
    table gives an empty table; other columns are ignored.  n-grams are compared by
    64-bit hash, whole sets by 128 bits.

    Plan: signatures are narrow and written to the shared folder; the texts are shuffled
    once more for the sets of candidates only.  Nothing is broadcast or sent to the driver.
    A hub of g n-grams is shuffled max(8, g / MOST_GRAMS) times, and comparing its texts
    costs the square of their number; hubs do not meet each other.  Hot keys: copies and
    buckets are counted with map-side aggregation and joined back from rewritten tables,
    where AQE can split.
    """
    bands, rows = plan_bands(threshold, recall)
    tables = Rounds(docs.sparkSession)
    cut = tables.cut
    # rows that share an id are told apart by the print of their text
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    signed = cut(d.mapInArrow(released(_sign(size, bands, rows)), returns("print bigint, n int, sig binary, bands array<bigint>", id=d.schema["id"].dataType)))
    # a number for each different set, written once so that it stays
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print"))
    reps = signed.where("sig is not null").groupBy("sig").agg(least.alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = cut(reps.select("sig", F.col("rep.id").alias("rep"), F.col("rep.print").alias("print"), "n", "bands", F.monotonically_increasing_id().alias("node")))
    spread = reps.select("node", "n", F.posexplode("bands").alias("k", "v")).select(F.xxhash64("k", "v").alias("bucket"), "node", "n")
    # a bucket's leader is the least by hash, so buckets that overlap share it
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"]
    groups = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), leader.alias("leader")).where("m > 1"))
    small = cut(spread.join(groups.where(F.col("m") <= pairwise).select("bucket"), "bucket"))
    one, two = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("an")), small.select("bucket", F.col("node").alias("b"), F.col("n").alias("bn"))
    pairs = one.join(two, "bucket").where("a < b").where(F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(threshold)).select("a", "b").distinct()
    told = cut(spread.join(groups.where(F.col("m") > pairwise).select("bucket", "leader"), "bucket").select("node", "leader").distinct())
    placed = None
    if not told.isEmpty():
        hubs = components(told.select(F.col("node").alias("a"), F.col("leader").alias("b")), tables).withColumnRenamed("root", "hub")
        grams = hubs.join(reps.select("node", "n"), "node").groupBy("hub").agg(F.sum("n").alias("grams"))
        block = F.greatest(F.lit(LEAST_GRAMS), F.least(F.lit(MOST_GRAMS), F.col("grams") / 8))
        placed = hubs.join(grams.select("hub", F.ceil(F.col("grams") / block).cast("int").alias("blocks")), "hub")
        placed = cut(placed.select("node", "hub", "blocks", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int").alias("block")))
        for end in ("a", "b"):
            pairs = pairs.join(placed.select(F.col("node").alias(end), F.col("hub").alias(f"hub_{end}")), end, "left")
        # texts of one hub meet in its blocks
        pairs = pairs.where("hub_a is null or hub_b is null or hub_a != hub_b").select("a", "b")
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = (wanted.unionByName(placed.select("node")) if placed else wanted).distinct()
    wanted = cut(reps.join(wanted, "node").select(F.col("rep").alias("id"), "print", "node"))
    # candidates grow with the corpus: the same plan at every size
    of = wanted.select(F.col("id").alias("of"), F.col("print").alias("of_print"), "node").hint("merge")
    sets = d.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print"))).dropDuplicates(["node"]).select("node", "text", "print")
    sets = cut(sets.mapInArrow(released(_sets(size)), "node bigint, grams array<bigint>"))
    links = cut(_verify(pairs, sets).where(F.col("j") >= threshold))
    counted = [links.select(F.col(end).alias("node"), F.lit(1).cast("bigint").alias("n")) for end in ("a", "b")]
    edges = links.select("a", "b")
    if placed:
        blocks = _held(sets, placed).groupBy("hub", "lo", "hi")
        found = cut(blocks.applyInArrow(lambda key, table: _Blocks(key, table, threshold).count(), "a bigint, b bigint, n bigint"))
        counted.append(found.where("b is null").select(F.col("a").alias("node"), "n"))
        edges = edges.unionByName(found.where("b is not null").select("a", "b"))
        links = links.unionByName(blocks.applyInArrow(lambda key, table: _Blocks(key, table, threshold).list(), "a bigint, b bigint, j double"))
    roots = components(edges, tables)
    ends = counted[0]
    for more in counted[1:]:
        ends = ends.unionByName(more)
    ends = ends.groupBy("node").agg(F.sum("n").alias("n_links"))
    names = reps.select("node", "rep")
    least = cut(roots.join(names, "node").groupBy("root").agg(F.min("rep").alias("class_id")))
    known = reps.select("sig", "rep", "node").join(roots, "node", "left").join(least, "root", "left").join(ends, "node", "left")
    class_id = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("class_id"))
    known = cut(known.select("sig", F.col("rep").alias("copy_id"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    out = signed.select("id", "sig").join(known, "sig", "left")
    own = lambda c: F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col(c)).alias(c)
    out = out.select(F.col("id").alias(id_col), own("copy_id"), own("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    for end in ("a", "b"):
        links = links.join(names.select(F.col("node").alias(end), F.col("rep").alias(f"id_{end}")), end)
    greatest = F.when(F.col("id_a").isNotNull() & F.col("id_b").isNotNull(), F.greatest("id_a", "id_b"))
    links = links.select(F.least("id_a", "id_b").alias("a"), greatest.alias("b"), "j")
    tables.drop(groups, small, told, wanted, pairs)
    return out, links
