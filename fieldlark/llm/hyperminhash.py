"""Near-duplicates by HyperMinHash: compressed sketches are banded, estimated, and verified on full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import released, returns
from fieldlark.llm.near_dup import _grams, _held, _sets, _slices
from fieldlark.llm.words import LOWER, mix
from fieldlark.operators.components import components
from fieldlark.operators.lineage import Rounds

#: Registers of a sketch, in bands of ROWS; a register has 6 bits of leading zeros and MANTISSA bits after the first one.
BANDS, ROWS, MANTISSA = 25, 5, 26
REGISTERS = BANDS * ROWS
EMPTY = np.uint32(0xFFFFFFFF)
#: Standard deviations by which an estimate may miss the threshold before a pair is given up.
SLACK = 6.0
#: Buckets of up to so many different texts are compared pair by pair; in larger ones all texts meet
#: a leader first, then those that are not linked to it meet the others block by block.
PAIRWISE = 16
#: 64-bit numbers (shingles and sketch) in a block; a task holds two blocks.
BLOCK = 2_000_000
_CHUNK = 256


def sketches(x: np.ndarray, doc: np.ndarray, n_docs: int, mantissa: int = MANTISSA) -> np.ndarray:
    """(documents, REGISTERS): per bucket the least hash of its shingles as leading zeros and
    the bits after the first one, or EMPTY."""
    y = mix(x ^ np.uint64(0x2545F4914F6CDD1D))
    bucket = ((y >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(n_docs * REGISTERS, np.uint64(1) << np.uint64(53), dtype=np.uint64)
    v = mix(x ^ np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(11)
    np.minimum.at(least, doc.astype(np.int64) * REGISTERS + bucket.astype(np.int64), v)
    bits = np.frexp(least.astype(np.float64))[1]  # exact: at most 53 bits
    zeros = (53 - np.minimum(bits, 53)).astype(np.uint64)
    after = (least << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    packed = (zeros << np.uint64(26)) | ((after >> np.uint64(53 - mantissa)) << np.uint64(26 - mantissa))
    return np.where(bits > 53, EMPTY, packed.astype(np.uint32)).reshape(n_docs, REGISTERS)


def chance(n: np.ndarray, m: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Probability that the registers of unlike shingles agree, for sets of ``n`` and ``m``.

    A register's hash has the density k * exp(-k * y), k shingles to a bucket; the cells of the
    level of e leading zeros are 2 ** -(e + 1 + mantissa) wide.
    """
    a, b = np.asarray(n, float)[..., None] / REGISTERS, np.asarray(m, float)[..., None] / REGISTERS
    edges = 0.5 ** np.arange(54)
    within = np.exp(-(a + b) * edges[1:]) - np.exp(-(a + b) * edges[:-1])
    return (a * b / (a + b) * within * edges[1:] * 0.5**mantissa).sum(-1)


def estimate(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of sketches row by row, less the agreements that chance brings, and the registers it rests on."""
    in_one, in_two = one != EMPTY, two != EMPTY
    used = (in_one | in_two).sum(-1)
    agree = ((one == two) & in_one).sum(-1)
    sizes, at = np.unique(np.stack(np.broadcast_arrays(n, m)), axis=1, return_inverse=True)
    p = chance(*sizes, mantissa)[at]  # unlike registers that agree stand to those that do not as p to 1 - p
    by_chance = p / (1 - p) * (in_one & in_two & (one != two)).sum(-1)
    return (agree - by_chance) / np.maximum(used, 1), used


def promising(j: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    return j >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), REGISTERS)


def _sign(size: int, kind):
    def run(batches):
        for ids, texts, prints in _slices(batches):
            x, n = _grams(texts, size, kind)
            ends = np.cumsum(n)
            sets = [np.unique(x[e - k : e]) if k else None for e, k in zip(ends, n)]
            regs = sketches(x, np.repeat(np.arange(len(n)), n), len(n))
            sig = [None if s is None else xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            regs = [None if s is None else r.tobytes() for s, r in zip(sets, regs)]
            count = pa.array([0 if s is None else len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, prints, count, pa.array(sig, pa.binary()), pa.array(regs, pa.binary())], names=["id", "print", "n", "sig", "regs"])

    return run


def _bands(batches):
    """(node, n, regs) -> (bucket, band, node, n): a bucket for each band that is not all empty."""
    for b in batches:
        if not b.num_rows:
            continue
        regs = _regs(b.column(2))
        at, band, bucket = [], [], []
        for k in range(BANDS):
            part = regs[:, k * ROWS : (k + 1) * ROWS]
            some = np.flatnonzero((part != EMPTY).any(1))
            acc = np.full(len(some), k + 1, dtype=np.uint64)
            for c in range(ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ part[some, c].astype(np.uint64))
            at.append(some)
            band.append(np.full(len(some), k, dtype=np.int32))
            bucket.append(acc.view(np.int64))
        at = np.concatenate(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(bucket)), pa.array(np.concatenate(band)), pa.array(b.column(0).to_numpy()[at]), pa.array(b.column(1).to_numpy()[at])], names=["bucket", "band", "node", "n"]
        )


def _estimated(threshold: float):
    """(a, b, na, nb, ra, rb) -> (a, b) of pairs whose estimate may reach the threshold."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = promising(*estimate(_regs(b.column(4)), _regs(b.column(5)), n, m), threshold)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], names=["a", "b"])

    return run


class _Classes:
    """Two blocks of a bucket (or one, twice): links between texts of different classes, enough to join what is linked."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table, threshold: float):
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable"))).combine_chunks()
        self.ids, self.threshold = table.column("node").to_numpy(), threshold
        block, lists = table.column("block").to_numpy(), table.column("grams").combine_chunks()
        self.regs = _regs(table.column("regs").combine_chunks())
        self.some = (self.regs != EMPTY).astype(np.float32)
        self.used = self.some.sum(1)
        self.starts, self.flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)  # sets are in this order
        self.n = np.diff(self.starts)
        _, self.of = np.unique(table.column("root").to_numpy(), return_inverse=True)
        self.band = table.column("band")[0].as_py()
        lo, hi = key[1].as_py(), key[2].as_py()
        self.one, self.two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        self.edges: list[tuple[int, int]] = []

    def _linked(self, i: int, who: np.ndarray) -> np.ndarray:
        """Which of ``who`` reach the threshold with text i, on the full sets."""
        x = self.flat[self.starts[i] : self.starts[i + 1]]
        n = self.n[who]
        at = np.repeat(self.starts[who] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        y = self.flat[at]
        k = np.minimum(np.searchsorted(x, y), len(x) - 1)
        common = np.bincount(np.repeat(np.arange(len(who)), n), weights=x[k] == y, minlength=len(who))
        return common / (n + len(x) - common) >= self.threshold

    def _ask(self, i: int, others: np.ndarray) -> None:
        others = others[self.of[others] != self.of[i]]
        if not len(others):
            return
        own = self.regs[i]
        same = (self.regs[others] == own) & (own != EMPTY)
        # what chance brings only lowers an estimate, so most are told apart without it
        used = self.used[others] + self.used[i] - self.some[others] @ self.some[i]
        ok = np.flatnonzero(promising(same.sum(1) / np.maximum(used, 1), used, self.threshold))
        # a pair is judged in the first of the bands it shares, in whose bucket it meets as well
        bands = self.band * ROWS
        met = (self.regs[others[ok], :bands] == own[:bands]).reshape(len(ok), self.band, ROWS).all(2) & same[ok, :bands].reshape(len(ok), self.band, ROWS).any(2)
        others = others[ok[~met.any(1)]]
        if not len(others):
            return
        j, used = estimate(self.regs[others], own[None], self.n[others], self.n[i][None])
        ok = np.flatnonzero(promising(j, used, self.threshold))
        others = others[ok[np.argsort(-j[ok], kind="stable")]]
        while len(others):
            asked, others = others[:_CHUNK], others[_CHUNK:]
            for y in asked[self._linked(i, asked)].tolist():
                if self.of[y] != self.of[i]:
                    self.edges.append((self.ids[i], self.ids[y]))
                    self.of[self.of == self.of[y]] = self.of[i]
            others = others[self.of[others] != self.of[i]]

    def table(self) -> pa.Table:
        """(a, b).  Every pair of two classes has an end outside the largest one, which asks."""
        if len(self.one) and len(self.two):
            most = int(np.bincount(self.of[np.concatenate((self.one, self.two))]).argmax())
            head = int(np.flatnonzero(self.of == most)[0])
            alone = self.one[0] == self.two[0]
            for i in self.one.tolist():
                if self.of[i] != self.of[head]:
                    self._ask(i, self.two[(self.two > i) | (self.of[self.two] == self.of[head])] if alone else self.two)
            for i in () if alone else self.two.tolist():
                if self.of[i] != self.of[head]:
                    self._ask(i, self.one[self.of[self.one] == self.of[head]])
        a, b = zip(*self.edges) if self.edges else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: float = 0.85, pairwise: int = PAIRWISE) -> DataFrame:
    """Connected components of documents whose sets of word shingles have a Jaccard similarity of at least ``threshold``.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  Returns one row per document: id,
    ``n_shingles`` (size of its set), ``component_id`` (the least id of its component), ``kept``
    (is that its own id?).

    A sketch has a register for each of 125 buckets of shingle hashes: the leading zeros of the
    bucket's least hash and the bits after the first one.  Five registers make a band; texts
    that agree in a band, not all of it empty, are candidates.  Two sets at the threshold share
    none of the 25 bands with a probability of at most 4e-7 (large sets; less for small ones,
    whose registers are mostly empty or of one shingle).  Candidates whose estimated
    similarity, corrected for registers that agree by chance, is within ``SLACK`` standard
    deviations of the threshold are verified on the full sets.  Sets too small to have a
    partner of another set (under t / (1 - t) shingles) are only matched as exact copies.

    Edge cases: texts without words (null, empty, blank) have no shingles and are components
    of their own; a text of fewer words than ``size`` has one shingle, all its words; rows
    that share an id are judged each by their own text; a row without an id is linked like any
    other, its component's id is the least of those there are, null if none, and it is kept
    where that is null; ids of any type that can be ordered are kept as they are; an empty
    table gives an empty table; other columns are ignored.  Shingles are compared by 64-bit
    hash, whole sets by 128 bits.

    Plan: sketches are written to the shared folder; texts are shuffled once, for the sets of
    candidates.  Exact copies fall together first.  Buckets of up to ``pairwise`` texts are
    compared pair by pair.  In larger ones every text meets the bucket's leader, and what is linked
    to it is a class; only buckets that still hold several classes are dealt into blocks, two
    of which meet in a task, where texts of different classes are compared until they are
    joined or told apart, each pair in the first band that it shares.  So a group of near copies never makes its pairs, and no link
    between classes is lost.  Copies and buckets are counted with map-side aggregation and
    joined from written tables, where AQE can split hot ones.  Nothing is broadcast or collected.
    """
    tables = Rounds(docs.sparkSession)
    cut = tables.cut
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    signed = cut(d.mapInArrow(released(_sign(size, LOWER)), returns("print bigint, n bigint, sig binary, regs binary", id=d.schema["id"].dataType)).select("id", "print", "n", "sig", "regs"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print"))
    reps = signed.where("sig is not null").groupBy("sig").agg(first.alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = cut(reps.select("sig", F.col("rep.id").alias("rep"), F.col("rep.print").alias("print"), "n", "regs", F.monotonically_increasing_id().alias("node")))
    alone = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else None
    asked = reps.where(F.col("n") >= alone) if alone is not None else reps.where("false")
    spread = cut(asked.select("node", "n", "regs").mapInArrow(released(_bands), "bucket bigint, band int, node bigint, n bigint"))
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n"))
    groups = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + REGISTERS // 2).alias("load"), leader.alias("leader")).where("m > 1"))
    met = cut(spread.join(groups.select("bucket", "m", "load", F.col("leader.node").alias("leader"), F.col("leader.n").alias("nl")), "bucket"))
    small, large = met.where(F.col("m") <= pairwise), met.where(F.col("m") > pairwise)
    one, two = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("na")), small.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"))
    led = large.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.col("n").alias("na"), F.col("nl").alias("nb"))
    like = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)
    pairs = one.join(two, "bucket").where("a < b").select("a", "b", "na", "nb").unionByName(led).where(like).select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("regs").alias(f"r{end}")), end)
    pairs = cut(pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(released(_estimated(threshold)), "a bigint, b bigint"))
    # texts are shuffled once: for pairs, and for the large buckets, of which few come to blocks
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    wanted = reps.select("node", F.col("rep").alias("id"), "print").join(wanted, "node")
    of = wanted.select(F.col("id").alias("of"), F.col("print").alias("of_print"), "node").hint("merge")
    sets = d.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print"))).dropDuplicates(["node"]).select("node", "text", "print")
    sets = cut(sets.mapInArrow(released(_sets(size, LOWER)), "node bigint, grams array<bigint>"))
    ga, gb = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(gb, "b").join(ga, "a").select("a", "b", (F.size("ga") + F.size("gb")).alias("n"), F.size(F.array_intersect("ga", "gb")).alias("i"))
    links = cut(both.where(F.col("i") / (F.col("n") - F.col("i")) >= threshold).select("a", "b"))
    # texts linked to the leader of their bucket are one class, the others start on their own
    of_leader = links.select("a", "b", F.lit(True).alias("linked"))
    held = large.join(of_leader, (F.least("node", "leader") == F.col("a")) & (F.greatest("node", "leader") == F.col("b")), "left")
    held = held.select("bucket", "band", "node", "load", F.when(F.col("linked") | (F.col("node") == F.col("leader")), F.col("leader")).otherwise(F.col("node")).alias("root"))
    held = cut(held)
    apart = cut(held.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket"))
    if not apart.isEmpty():
        blocks = F.ceil(F.col("load") / BLOCK).cast("int")
        placed = held.join(apart, "bucket").select("node", F.col("bucket").alias("hub"), "band", "root", blocks.alias("blocks"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
        dealt = _held(sets.join(reps.select("node", "regs"), "node"), placed, ("band", "root", "regs")).groupBy("hub", "lo", "hi")
        links = links.unionByName(cut(dealt.applyInArrow(lambda key, table: _Classes(key, table, threshold).table(), "a bigint, b bigint")))
    roots = components(links, tables)
    names = reps.select("sig", "rep", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(names.groupBy("root").agg(F.min("rep").alias("component_id")))
    known = cut(names.join(least, "root").select("sig", "component_id"))
    out = signed.select("id", "n", "sig").join(known, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    tables.drop(groups, met, pairs, held)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
