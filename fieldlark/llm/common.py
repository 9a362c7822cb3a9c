"""What the operators of this subpackage share: tables, lineage cuts, row hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.operators.lineage import Rounds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back: lineage and partitioning end here."""
    return Rounds(df.sparkSession).cut(df)


def returns(out: str, **kept: T.DataType) -> T.StructType:
    """The schema of a function over Arrow batches: columns that come along, whatever their types, then those of ``out``."""
    return T.StructType([T.StructField(n, kind) for n, kind in kept.items()] + T.StructType.fromDDL(out).fields)


def give_back() -> None:
    """Return freed memory of this Python to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives back its memory at the end of a task: workers are
    used again by later stages, whose needs would come on top."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one narrow aggregate, used to size groups."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 that depends on ``cols`` and ``seed`` only."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
