"""Exact medians by selection against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import features


@pytest.mark.parametrize("held, bins", [(4, 3), (10, 16), (1000, 8)])
def test_medians_of_keys(spark, held, bins):
    rng = random.Random(held)
    groups = {
        ("a", 0): [rng.gauss(0, 1) for _ in range(501)], ("a", 1): [rng.gauss(0, 1e-9) + 1e6 for _ in range(200)], ("b", 0): [7.0] * 300, ("b", 1): [1.0, 2.0], ("b", 2): [5.0],
        ("c", 0): [0.0] * 150 + [1.0] * 150, ("c", 1): [-1e300, 1e300, 3.0, 4.0] * 20, ("c", 2): [float(rng.randint(0, 3)) for _ in range(99)],
    }
    rows = [(*k, v) for k, x in groups.items() for v in x] + [("a", 0, None), ("d", 0, None)]
    df = spark.createDataFrame(rows, "link_id string, k int, amp double").repartition(5)
    got = {(r.link_id, r.k): r.median for r in features.median(df, "amp", held=held, bins=bins).collect()}
    assert got == {k: pytest.approx(np.median(x), abs=1e-12, rel=1e-15) for k, x in groups.items()}
    assert features.median(df.where("false"), "amp").count() == 0


def test_median_of_ten_million_values_of_one_key(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("only").alias("link_id"), F.lit(0).alias("k"), (F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 4).alias("amp"))  # every value once, mixed
    assert [tuple(r) for r in features.median(df, "amp").collect()] == [("only", 0, (n - 1) / 2 / 4)]
