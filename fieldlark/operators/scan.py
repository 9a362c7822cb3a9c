"""Recurrences and windows along keys of any length, over many tasks a key.

Rows are dealt into chunks by range of (key, order), so a long key spans many chunks and a chunk
holds many short keys.  A linear recurrence is an affine map per row; maps compose, so every chunk
is scanned on its own, what one chunk hands to the next is found from one row a chunk, and added
to the rows of the chunk's first key.  Windows work on blocks of positions with a halo of the
rows before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.operators.lineage import Rounds

#: Rows of a key that one task takes in its stride; windows over longer keys work in blocks.
BLOCK_ROWS = 1 << 16


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[t] = a[t] * x[t - 1] + b[t] with x[-1] = 0, by doubling; ``b`` has one row or number for each of ``a``."""
    a, x, step = a.astype(float), b.astype(float), 1
    wide = (slice(None),) + (None,) * (x.ndim - 1)
    while step < len(a):
        x[step:] += a[step:][wide] * x[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return x


def _scan_chunk(n_keys: int, vector: bool, names: list[str]):
    """Rows of a partition in order -> with x as if each key began here, the product of a along the
    partition's first key (0 in others), the chunk and the place in it."""

    def numbers(column: pa.Array) -> np.ndarray:
        if not vector:
            return column.to_numpy(zero_copy_only=False).astype(float)
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = TaskContext.get().partitionId(), 0
        key = first = x = None
        product = 1.0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
            a = batch.column(batch.num_columns - 3).to_numpy(zero_copy_only=False).astype(float)
            b, init = numbers(batch.column(batch.num_columns - 2)), numbers(batch.column(batch.num_columns - 1))
            first = keys[0] if first is None else first
            new = np.fromiter((k != p for k, p in zip(keys, [key, *keys[:-1]])), dtype=bool, count=len(keys))
            head = np.fromiter((k == first for k in keys), dtype=bool, count=len(keys))
            wide = (slice(None),) + (None,) * (b.ndim - 1)
            start = np.where(new[wide], init, 0.0)
            if not new[0]:
                start[0] = x
            own = np.where(new, 0.0, a)
            own[0] = 0.0
            out = affine_scan(own, b + a[wide] * start)
            along = np.where(head, np.cumprod(np.where(head, a, 0.0)) * product, 0.0)
            product = float(along[-1])
            key, x = keys[-1], out[-1]
            size = len(keys)
            made = pa.array(list(out), pa.list_(pa.float64())) if vector else pa.array(out)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: batch.num_columns - 3], made, pa.array(along), pa.array(head), batch.column(batch.num_columns - 1), pa.array(np.full(size, chunk, dtype=np.int32)), pa.array(np.arange(n, n + size))], names=names
            )
            n += size

    return run


def scan_linear(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, init: Column, name: str, chunks: int | None = None) -> DataFrame:
    """``df`` with ``name``: x[t] = a[t] * x[t - 1] + b[t] along each key, where x before a key's first row is that row's ``init``.

    ``b`` and ``init`` are numbers or arrays of one width, ``a`` is a number; none may be null.  Rows
    that agree in key and order are taken in any order.  One shuffle by range; what goes through
    the driver is one row for each of the ``chunks`` (by default as many as shuffle partitions).
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in keys]
    wide = df.select(*keys, *rest, a.cast("double").alias("_a"), b.alias("_b"), init.alias("_init"))
    vector = isinstance(wide.schema["_b"].dataType, T.ArrayType)
    kind = T.ArrayType(T.DoubleType()) if vector else T.DoubleType()
    wide = wide.withColumns({c: F.col(c).cast(kind) for c in ("_b", "_init")})
    added = [T.StructField("_x", kind), T.StructField("_along", T.DoubleType()), T.StructField("_head", T.BooleanType()), T.StructField("_init", kind), T.StructField("_chunk", T.IntegerType()), T.StructField("_n", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema if f.name not in ("_a", "_b", "_init")] + added)
    dealt = wide.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    local = Rounds(spark).cut(dealt.mapInArrow(_scan_chunk(len(keys), vector, schema.names), schema))
    key = F.struct(*keys)
    ends = local.groupBy("_chunk").agg(
        F.min_by(F.struct(key.alias("key"), "_init"), "_n").alias("first"),
        F.max_by(F.struct(key.alias("key"), F.col("_x").alias("x")), "_n").alias("last"),
        F.max_by(F.struct(F.col("_x").alias("x"), F.col("_along").alias("along")), F.when(F.col("_head"), F.col("_n"))).alias("head"),
    )
    carried, before = [], None
    for r in ends.orderBy("_chunk").collect():
        at, number = np.asarray(r.head.x, dtype=float), (lambda v: np.asarray(v, dtype=float))
        if before is not None and before[0] == r.first.key:
            more = before[1] - number(r.first._init)
            carried.append((r._chunk, more.tolist()))
            at = at + r.head.along * more
        before = (r.last.key, at if r.last.key == r.first.key else number(r.last.x))
    if not carried:
        return local.select(*df.columns, F.col("_x").alias(name))
    moved = spark.createDataFrame(carried, T.StructType([T.StructField("_chunk", T.IntegerType()), T.StructField("_more", kind)])).coalesce(1)
    whole = local.join(F.broadcast(moved), "_chunk", "left")
    on = F.zip_with("_x", "_more", lambda x, m: x + F.col("_along") * m) if vector else F.col("_x") + F.col("_along") * F.col("_more")
    return whole.select(*df.columns, F.when(F.col("_head") & F.col("_more").isNotNull(), on).otherwise(F.col("_x")).alias(name))


def positions(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` with ``_pos``: the place of a row along its key, from 0."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return scan_linear(df, keys, order, one, one, zero, "_pos", chunks).withColumn("_pos", F.col("_pos").cast("bigint") - 1)


def in_blocks(df: DataFrame, keys: list[str], order: list[str], before: int, rows: int | None = None) -> DataFrame:
    """``df`` with ``_pos``, ``_block`` and ``_halo``: blocks of ``rows`` positions of a key, each with the
    ``before`` rows ahead of it as its halo.

    Where no key has more than ``rows`` rows, all are of block 0 and have no halo; what is made
    of the blocks is the same.
    """
    rows = max(rows or BLOCK_ROWS, before, 1)
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"_pos": F.row_number().over(w).cast("bigint") - 1, "_block": F.lit(0).cast("bigint"), "_halo": F.lit(False)})
    placed = positions(df, keys, order).withColumn("_block", F.floor(F.col("_pos") / rows))
    ends = F.col("_pos") % rows >= rows - before
    own, next_ = F.struct(F.col("_block").alias("b"), F.lit(False).alias("h")), F.struct((F.col("_block") + 1).alias("b"), F.lit(True).alias("h"))
    both = placed.withColumn("_at", F.explode(F.when(ends, F.array(own, next_)).otherwise(F.array(own))))
    return both.withColumns({"_block": F.col("_at.b"), "_halo": F.col("_at.h")}).drop("_at")
