"""Rows split into sound and faulty ones in one pass, the faults counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldlark.functions.predicates import first_fault
from fieldlark.operators.lineage import Rounds


def split_once(df: DataFrame, faults: dict[str, Column], tables: Rounds) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sound rows, faulty rows with their ``fault``, rows per fault and ``sound``).

    The input is evaluated once, to a table in the shared folder that both parts read with the
    split pushed down; counts are metrics observed by that write, a number each.
    """
    seen = Observation()
    names = list(faults)
    marked = df.withColumn("fault", first_fault(faults))
    counts = [F.count_if(F.col("fault") == n).alias(f"c{k}") for k, n in enumerate(names)]
    written = tables.cut(marked.observe(seen, F.count_if(F.col("fault").isNull()).alias("sound"), *counts))
    got = seen.get
    return written.where("fault is null").drop("fault"), written.where("fault is not null"), {"sound": got["sound"]} | {n: got[f"c{k}"] for k, n in enumerate(names)}
