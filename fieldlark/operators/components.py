"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators.lineage import Rounds


def components(links: DataFrame, tables: Rounds) -> DataFrame:
    """(a, b) links -> (node, root) with the least node of each component as root; nodes of any type that can be ordered.

    Every round works on the link table with map-side minima and joins that AQE can
    split; nothing is collected but a row count and a checksum.  The tables of a round
    are written to the shared folder and go when the next one is; the result is a table of
    ``tables``.  Nodes without links do not appear.  The number of rounds grows with the
    logarithm of the nodes, whatever the diameter of a component.
    """
    rounds = Rounds(links.sparkSession)

    def least(edges: DataFrame) -> DataFrame:
        """Per node u of (u, v): the least of u and its v; a table, so that a hot node can be split."""
        return rounds.cut(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))

    edges = rounds.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            ends = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")))
            found = tables.cut(ends.groupBy("node").agg(F.min("root").alias("root")))
            rounds.forget(0)
            return found
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = rounds.cut(large).select(F.col("b").alias("u"), F.col("a").alias("v"))
        joined = down.join(least(down), "u")
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = rounds.cut(small.where("a < b").distinct())
        rounds.forget(1)
