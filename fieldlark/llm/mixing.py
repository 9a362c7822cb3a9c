"""Mixing sources to target weights by Pareto order sampling (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, uniform

#: A table of one row per source is broadcast up to so many sources, else it is shuffled.
BROADCAST_SOURCES = 100_000
#: Buckets of the rank per source; only the bucket in which a sample ends is ranked row by row.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Targets share the sum of all sizes by weight and stop at ``cap`` times their
    source's size; the excess is shared again by weight until none is above.  In
    order of cap per weight the capped sources come first, so the fixed point is
    found with running sums: target = min(cap, level * weight).  The window runs over
    one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    s = s.withColumn("limit", F.col("source_size").cast("double") * cap)
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.row_number().over(by_room).alias("k"), F.col("level")))).over(everything)["level"]
    s = s.withColumn("final", level)
    return s.select("source", "source_size", "weight", F.least(F.col("limit"), F.col("final") * F.col("weight")).alias("target"))


def _per_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = 7,
    size_power: float = 0.5,
    row_col: str | None = None,
) -> DataFrame:
    """How many whole copies of each document the mix takes.

    A document's size is its number of words.  A source's target is split over its
    documents as expected copies e = min(cap, c * size ** size_power), with c so that
    the expected words are the target.  floor(e) copies are certain.  For the
    remainder the inclusion odds are p / (1 - p) with p = e - floor(e): documents are
    ranked by the odds of a uniform number over these odds (Pareto order sampling)
    and taken in that order until the words left for the source are used up; the last
    one is taken if that brings the sum nearer.  No document exceeds ``cap`` copies
    (``cap`` whole).

    Returns one row per input row: id, source, ``size``, ``source_size``, ``target``,
    ``copies``, ``taken``, and ``row_col`` of the row, if given.  Random numbers depend on id, size and seed only, so reruns
    agree.

    Edge cases: null text has size 0 and takes 0; a null source is a source of its
    own, last in order; rows with equal ids are separate documents (equal rows share
    a random number and are ordered arbitrarily among themselves); an empty table
    gives an empty table; other columns are ignored.

    Plan: texts are read once, to a narrow table of sizes in the shared folder.
    Everything per source works on aggregates: distinct sizes for c, rank buckets for
    the end of the sample.  Only documents of the one bucket where a source's sample
    ends are sorted, so a source that holds a third of all rows is never in one task.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(row_col).alias("row")] if row_col else [])))
    by_size = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    # c: in falling order of size the capped documents come first
    rate = F.pow(F.col("size").cast("double"), F.lit(size_power))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = F.col("n") * F.col("size").cast("double")
    g = by_size.where("size > 0").withColumn("rate", rate)
    g = g.withColumn("full", F.coalesce(F.sum(words * cap).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    g = g.withColumn("open", F.sum(words * F.col("rate")).over(falling.rowsBetween(0, Window.unboundedFollowing)))
    g = g.join(targets.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    g = g.withColumn("c", (F.col("target") - F.col("full")) / F.col("open")).where((F.col("c") >= 0) & (F.col("c") * F.col("rate") <= cap * (1 + 1e-12)))
    solved = g.groupBy(F.col("source").alias("of")).agg(F.max_by("c", "size").alias("c"))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    per_source = cut(targets.join(solved.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"))
    few = per_source.count() <= BROADCAST_SOURCES

    rows = _per_source(sized, per_source, few)
    # a source whose target is its cap has no open group: all its documents are full
    e = F.least(F.lit(float(cap)), F.coalesce(F.col("c"), F.lit(float(cap))) * F.pow(F.col("size").cast("double"), F.lit(size_power)))
    rows = rows.withColumn("e", F.when(F.col("size") > 0, F.when(F.col("c").isNull(), F.lit(float(cap))).otherwise(e)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("e") + 1e-9)).withColumn("p", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)))
    u = uniform(F.col("id"), F.col("size"), seed=seed)
    # rank r/(1+r) with r = [u/(1-u)] / [p/(1-p)], a number between 0 and 1 in the order of r
    rows = rows.withColumn("r", F.when(F.col("p") > 0, u * (1 - F.col("p")) / (u * (1 - F.col("p")) + F.col("p") * (1 - u))).otherwise(F.lit(1.0)))
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("r") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.withColumn("may", (F.col("p") > 0) & (F.col("size") > 0))
    sums = rows.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("may"), F.col("size")).otherwise(0)).alias("w"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target")
    )
    ordered = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("room", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
    sums = sums.withColumn("upto", F.sum("w").over(ordered)).withColumn("room", F.col("room") - F.col("upto") + F.col("w"))
    # the first bucket that does not fit whole
    ends = cut(sums.where(F.col("room") < F.col("w")).groupBy(F.col("source").alias("of")).agg(F.min(F.struct("bucket", "room")).alias("end")))
    rows = _per_source(rows, ends, few)
    after = F.col("end").isNotNull() & (F.col("bucket") >= F.col("end.bucket"))
    clear = rows.withColumn("extra", (F.col("may") & ~after).cast("int"))
    last = F.col("may") & F.col("end").isNotNull() & (F.col("bucket") == F.col("end.bucket"))
    in_order = Window.partitionBy("source").orderBy("r", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = clear.where(F.coalesce(last, F.lit(False))).withColumn("run", F.sum("size").over(in_order))
    tail = tail.withColumn("extra", (F.col("run") - F.col("size") / 2.0 <= F.col("end.room")).cast("int"))
    out = clear.where(~F.coalesce(last, F.lit(False))).unionByName(tail.drop("run"))
    copies = (F.col("whole") + F.col("extra")).cast("bigint")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", F.col("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("row").alias(row_col)] if row_col else []))
