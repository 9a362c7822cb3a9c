"""Blocked moments of vectors: count, mean and co-moment matrix per key, merged pairwise.

A task adds up one matrix per key over Arrow batches, by a matrix product; what is shuffled is a
matrix for each key and task, not one number for each pair of a vector's entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that a task holds before it passes its matrices on.
HELD = 1 << 23
#: Parts of a key whose matrices are merged on their own before they meet.
PARTS = 32

Moments = tuple[int, np.ndarray, np.ndarray]


def of_block(x: np.ndarray) -> Moments:
    """Moments of the rows of ``x``; those of a constant are exactly its value and 0."""
    mean = np.where(x.min(axis=0) == x.max(axis=0), x[0], x.mean(axis=0))
    gap = x - mean
    return len(x), mean, gap.T @ gap


def merged(one: Moments, two: Moments) -> Moments:
    if len(one[1]) != len(two[1]):
        raise ValueError(f"vectors of one key differ in length: {len(one[1])} and {len(two[1])}")
    n = one[0] + two[0]
    gap = two[1] - one[1]
    return n, one[1] + gap * (two[0] / n), one[2] + two[2] + np.outer(gap, gap) * (one[0] * two[0] / n)


def _rows(held: dict[tuple, Moments], kinds: list[pa.DataType], names: list[str], part: int | None) -> pa.RecordBatch:
    keys = list(zip(*held)) if held else [[] for _ in kinds]
    cols = [pa.array(list(k), kind) for k, kind in zip(keys, kinds)]
    cols += [pa.array([m[0] for m in held.values()], pa.int64()), *(pa.array([m[i].ravel() for m in held.values()], pa.list_(pa.float64())) for i in (1, 2))]
    if part is not None:
        cols.append(pa.array([part] * len(held), pa.int32()))
    return pa.RecordBatch.from_arrays(cols, names=names)


def moments(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, m2): ``m2`` is the matrix of summed products of deviations, row by row.

    Vectors are arrays of one length a key, else a ValueError; a null vector or one of no numbers
    is left out, a null entry makes its row and column NaN.  Without keys there is one row,
    none for no vectors.
    """
    rows = df.select(*keys, F.col(x).cast("array<double>").alias("_x")).where(F.size("_x") > 0)
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name in keys]
    found = [T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("m2", T.ArrayType(T.DoubleType()))]
    full, parted = T.StructType(kept + found), T.StructType([*kept, *found, T.StructField("_part", T.IntegerType())])
    width = len(keys)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        held: dict[tuple, Moments] = {}
        size, kinds = 0, []
        for b in batches:
            kinds = [b.column(k).type for k in range(width)]
            lists = b.column(width)
            flat, length = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=float), np.diff(lists.offsets.to_numpy())
            start = np.concatenate(([0], np.cumsum(length)))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(width))) if width else [()] * b.num_rows):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                if len(set(length[at].tolist())) > 1:
                    raise ValueError(f"vectors of one key differ in length: {sorted(set(length[at].tolist()))}")
                new = of_block(np.stack([flat[start[i] : start[i + 1]] for i in at]))
                size += 0 if key in held else new[2].size
                held[key] = merged(held[key], new) if key in held else new
            if size > HELD:
                yield _rows(held, kinds, parted.names, part)
                held, size = {}, 0
        if held:
            yield _rows(held, kinds, parted.names, part)

    def together(part: bool, names: list[str]):
        def run(table: pa.Table) -> pa.Table:
            total = None
            for n, mean, m2 in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "m2"))):
                new = n, np.array(mean), np.array(m2).reshape(len(mean), -1)
                total = new if total is None else merged(total, new)
            key = tuple(table.column(k)[0].as_py() for k in keys)
            kinds = [table.schema.field(k).type for k in keys]
            return pa.Table.from_batches([_rows({key: total}, kinds, names, table.column("_part")[0].as_py() if part else None)])

        return run

    first = rows.mapInArrow(sums, parted).groupBy(*keys, "_part").applyInArrow(together(True, parted.names), parted)
    return first.groupBy(*keys).applyInArrow(together(False, full.names), full)


def pairs(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, k1, k2, m2, s1, s2): the entries of the matrices with the diagonals they belong to."""
    d = F.size("mean")
    at = F.sequence(F.lit(0), d * d - 1)
    rows = found.select(*keys, "n", d.alias("_d"), "m2", F.explode(at).alias("_at"))
    k1, k2 = F.floor(F.col("_at") / F.col("_d")).cast("int"), (F.col("_at") % F.col("_d")).cast("int")
    entry = lambda i: F.get("m2", i)
    return rows.select(*keys, "n", k1.alias("k1"), k2.alias("k2"), entry(F.col("_at")).alias("m2"), entry(k1 * (F.col("_d") + 1)).alias("s1"), entry(k2 * (F.col("_d") + 1)).alias("s2"))
