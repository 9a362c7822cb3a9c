"""Temporal and spectral features of frame sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.lineage import Rounds
from fieldlark.operators.moments import moments, pairs
from fieldlark.operators.preprocess import difference, over_time, own_rows, windowed

#: Values of a key that one task holds for its median, and parts of a range that are counted in a pass.
HELD_VALUES, BINS = 1 << 16, 1024


def energy(rows: DataFrame, x: str, axis: int = 0) -> DataFrame:
    """Sum of squares over time (axis 0) or over subcarriers (axis 1)."""
    return rows.groupBy("link_id", "k" if axis == 0 else "ts").agg(F.sum(F.col(x) * F.col(x)).alias("energy"))


def statistics(rows: DataFrame, x: str) -> DataFrame:
    return rows.groupBy("link_id", "k").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def spread(rows: DataFrame, x: str) -> DataFrame:
    return rows.groupBy("link_id", "k").agg((F.max(x) - F.min(x)).alias("range"))


def median(rows: DataFrame, x: str, keys: tuple[str, ...] = ("link_id", "k"), held: int = HELD_VALUES, bins: int = BINS) -> DataFrame:
    """(keys, median), exact, by selection: no task holds more than ``held`` values of a key.

    A key of more values is narrowed to the range around its middle ranks: each pass counts
    the values in the range by ``bins`` equal parts, summed in every task, and keeps the parts in
    which the middle ranks are, until few values are left or all that are left are equal.
    Nulls do not count; values must be finite.
    """
    spark, on = rows.sparkSession, list(keys)
    values = rows.select(*on, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    state = values.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    tables = Rounds(spark)
    state = tables.cut(state.withColumns({"below": F.lit(0).cast("bigint"), "inside": F.col("n"), "median": F.when(F.col("lo") == F.col("hi"), F.col("lo"))}))
    one, two = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # the middle ranks, from 0
    wide = F.col("median").isNull() & (F.col("inside") > held)
    while not (open_ := state.where(wide)).isEmpty():
        part = F.least(F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        within = values.join(open_, on).where(F.col("_x").between(F.col("lo"), F.col("hi")))
        counted = within.groupBy(*on, part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("least"), F.max("_x").alias("most"))
        placed = counted.join(open_.select(*on, "n", "below"), on)
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*on).orderBy("part"))
        placed = placed.withColumn("upto", upto).where((F.col("upto") > one) & (F.col("upto") - F.col("c") <= two))
        kept = placed.groupBy(*on).agg(F.first("n").alias("n"), F.min("least").alias("lo"), F.max("most").alias("hi"), F.min(F.col("upto") - F.col("c")).alias("below"), F.sum("c").alias("inside"), F.min_by("most", "part").alias("u"), F.max_by("least", "part").alias("v"), F.count(F.lit(1)).alias("parts"))
        # middle ranks in two parts are the last value of one and the first of the other
        known = F.when(F.col("parts") > 1, (F.col("u") + F.col("v")) / 2).when(F.col("lo") == F.col("hi"), F.col("lo"))
        kept = kept.select(*on, "n", "lo", "hi", "below", "inside", known.alias("median"))
        state = tables.cut(state.where(~wide).unionByName(kept))
        tables.forget(1)
    known = state.where("median is not null").select(*on, "median")
    left = values.join(state.where("median is null").drop("median"), on).where(F.col("_x").between(F.col("lo"), F.col("hi")))
    sorted_ = left.groupBy(*on, "n", "below").agg(F.array_sort(F.collect_list("_x")).alias("v"))
    at = lambda rank: F.get("v", (rank - F.col("below")).cast("int"))
    return known.unionByName(sorted_.select(*on, ((at(one) + at(two)) / 2).alias("median")))


def inter_subcarrier_variance(rows: DataFrame, x: str) -> DataFrame:
    return rows.groupBy("link_id", "ts").agg(F.var_pop(x).alias("variance"))


def correlation_matrix(frames: DataFrame, a: str = "amplitude") -> DataFrame:
    """Pearson correlations; NaN where a subcarrier is constant.  Needs two frames a link."""
    m = pairs(moments(frames, a, ["link_id"]), ["link_id"]).where("n >= 2")
    flat = (F.col("s1") <= 0) | (F.col("s2") <= 0)
    r = F.when(flat, F.lit(float("nan"))).when(F.col("k1") == F.col("k2"), F.lit(1.0)).otherwise(F.try_divide("m2", F.sqrt("s1") * F.sqrt("s2")))
    return m.select("link_id", "k1", "k2", r.alias("r"))


def covariance_matrix(frames: DataFrame, a: str = "amplitude") -> DataFrame:
    """Sample covariances, null for links of one frame."""
    m = pairs(moments(frames, a, ["link_id"]), ["link_id"])
    return m.select("link_id", "k1", "k2", F.when(F.col("n") >= 2, F.col("m2") / (F.col("n") - 1)).alias("c"))


def mean_correlation(frames: DataFrame, a: str = "amplitude") -> DataFrame:
    """Mean of the upper triangle; NaN for a single subcarrier."""
    upper = correlation_matrix(frames, a).where("k1 < k2").groupBy("link_id").agg(F.avg("r").alias("mean_r"))
    return frames.select("link_id").distinct().join(upper, "link_id", "left").withColumn("mean_r", F.coalesce("mean_r", F.lit(float("nan"))))


def temporal_features(rows: DataFrame, x: str, window: int, stride: int = 1) -> dict[str, DataFrame]:
    return {
        "first_diff": difference(rows, x, 1),
        "second_diff": difference(rows, x, 2),
        "total_energy": energy(rows, x, 0),
        "windowed_variance": windowed(rows, x, window, stride, F.var_pop, "variance"),
        "windowed_energy": windowed(rows, x, window, stride, lambda c: F.sum(c * c), "energy"),
    }


def spectral_features(frames: DataFrame, rows: DataFrame, x: str = "amp", a: str = "amplitude") -> dict[str, DataFrame]:
    return {
        "correlation_matrix": correlation_matrix(frames, a),
        "mean_correlation": mean_correlation(frames, a),
        "statistics": statistics(rows, x),
        "range": spread(rows, x),
        "inter_subcarrier_variance": inter_subcarrier_variance(rows, x),
    }


def default_window(n_frames: int) -> int:
    return max(1, n_frames // 4)


def rolling_activity(rows: DataFrame, x: str, frames_held: int = 10) -> DataFrame:
    """Mean absolute change inside the last ``frames_held`` frames, per link and time; 0 for the first.
    Blocks need a halo of ``frames_held`` frames."""
    block = [c for c in ("_block", "_halo") if c in rows.columns]
    steps = rows.withColumn("d", F.abs(F.col(x) - F.lag(x).over(over_time(rows)))).groupBy("link_id", "ts", *block).agg(F.avg("d").alias("d"))
    w = Window.partitionBy("link_id", *block[:1]).orderBy("ts").rowsBetween(-(frames_held - 2), 0)
    # the first row of a block's halo has no change of its own; it is before every window of the block
    return own_rows(steps.select("link_id", "ts", *block, F.coalesce(F.avg("d").over(w), F.lit(0.0)).alias("change")))
