"""Rounding of queries against SQL's, on values that lie between two results."""

import pytest
from pyspark.sql import functions as F

from fieldlark.plans.frame_queries import half_away


def test_ties_go_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    # positions of centroids of six places: one in forty lies between two of five places
    x = -5 + 0.25 * (F.round(F.col("id") / 10000 + 0.000007 * (F.col("id") % 13), 6))
    got = spark.range(40000).select(x.alias("x"), F.round(x, 5).alias("decimal"), half_away(x, 5).alias("five"), half_away(x, 6).alias("six")).toArrow()
    one = "select count(*) filter (round(x, 5) <> five or round(x, 6) <> six), count(*) filter (round(x, 5) <> decimal) from got"
    wrong, otherwise = duckdb.sql(one).fetchall()[0]
    assert wrong == 0 and otherwise > 0
