"""Ordered folds: one step function serves batch jobs and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(df: DataFrame, names: list[str], out: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name in names] + T._parse_datatype_string(out).fields)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by ``by`` in a fixed number of partitions: small rows that each become many must not be
    brought together by their size before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable, out: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output)`` over the rows of each key in order.

    Rows are shuffled by key and sorted inside partitions; a task streams them and holds
    one state, whatever the length of a key.  ``state`` is None at the start of a key; an
    output of None adds no row.  Rows and outputs are dicts: for steps that work on whole
    frames or documents.  Steps on plain numbers take ``fold_columns``.
    """
    full = _schema(df, keys + order, out)
    carried = [n for n in full.names if n in keys + order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        key, state = None, None
        for b in batches:
            rows = []
            for row in b.to_pylist():
                k = tuple(row[n] for n in keys)
                if k != key:
                    key, state = k, None
                state, result = step(state, row)
                if result is not None:
                    rows.append({n: row[n] for n in carried} | result)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)


def fold_columns(df: DataFrame, keys: list[str], order: list[str], values: list[str], step: Callable, out: str) -> DataFrame:
    """Run ``step(state, *values) -> (state, outputs)`` over the rows of each key in order.

    As ``fold_sorted``, but column by column: keys and order pass through as they are, a step
    gets and gives plain values, one output row for each input row.
    """
    full = _schema(df.select(*keys, *order), keys + order, out)
    carried = [n for n in full.names if n in keys + order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        kinds = arrow.types[len(carried) :]
        key, state = None, None
        for b in batches:
            column = {n: b.column(n) for n in b.schema.names}
            made = []
            for k, *x in zip(zip(*(column[n].to_pylist() for n in keys)), *(column[n].to_pylist() for n in values)):
                if k != key:
                    key, state = k, None
                state, result = step(state, *x)
                made.append(result)
            cols = [pa.array(list(c), kind) for c, kind in zip(zip(*made), kinds)] if made else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([column[n] for n in carried] + cols, schema=arrow)

    wanted = list(dict.fromkeys([*keys, *order, *values]))
    return df.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)
