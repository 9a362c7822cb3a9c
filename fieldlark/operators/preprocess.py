"""Phase and amplitude conditioning of frame sequences, on the long form (link_id, ts, k, x).

The time axis is a window over (link_id, k) in order of ts, so links and subcarriers run in
parallel; operators along subcarriers stay inside a frame.  Rows of frames that were dealt into
blocks (``scan.in_blocks``) are taken block by block, so a long link runs in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.arrays import wrapped_jump
from fieldlark.operators.scan import in_blocks


def over_time(rows: DataFrame | None = None):
    """The time axis; with the rows, within their blocks if they have some."""
    block = ["_block"] if rows is not None and "_block" in rows.columns else []
    return Window.partitionBy("link_id", *block, "k").orderBy("ts")


def own_rows(rows: DataFrame) -> DataFrame:
    """Without the rows that only lead up to a block, and its columns."""
    return rows.where(~F.col("_halo")).drop("_pos", "_block", "_halo") if "_halo" in rows.columns else rows


def over_subcarriers():
    return Window.partitionBy("link_id", "ts").orderBy("k")


def _unwrap(x: str, w) -> Column:
    jump = F.coalesce(wrapped_jump(F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    return jump


def unwrap(rows: DataFrame, x: str, w=None) -> DataFrame:
    """Unwrap phases along subcarriers, or along time with over_time()."""
    w = w or over_subcarriers()
    jumps = rows.withColumn("_jump", _unwrap(x, w))
    run = F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return jumps.withColumn(x, F.col(x) + run).drop("_jump")


def unwrap_in_time(rows: DataFrame, x: str) -> DataFrame:
    """``unwrap`` along time; in blocks with a halo of one frame the jumps of a block are summed, and
    the sums of the blocks before carried into it."""
    if "_block" not in rows.columns:
        return unwrap(rows, x, over_time())
    jumps = rows.withColumn("_jump", _unwrap(x, over_time(rows))).where(~F.col("_halo"))
    totals = jumps.groupBy("link_id", "k", "_block").agg(F.sum("_jump").alias("_sum"))
    ahead = Window.partitionBy("link_id", "k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("link_id", "k", "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0)).alias("_carry"))
    run = F.sum("_jump").over(over_time(rows).rowsBetween(Window.unboundedPreceding, 0))
    out = jumps.withColumn("_run", run).join(carry, ["link_id", "k", "_block"])
    return own_rows(out.withColumn(x, F.col(x) + F.col("_run") + F.col("_carry")).select(*rows.columns))


def difference(rows: DataFrame, x: str, order: int = 1) -> DataFrame:
    """Differences in time of first or second order; rows without enough predecessors go.  Blocks need a halo of ``order`` frames."""
    w = over_time(rows)
    d = F.col(x) - F.lag(x, 1).over(w)
    out = rows.withColumn(x, d)
    if order == 2:
        out = out.withColumn(x, F.col(x) - F.lag(x, 1).over(w))
    return own_rows(out).where(F.col(x).isNotNull())


def subtract_baseline(rows: DataFrame, x: str, baseline: DataFrame | None = None) -> DataFrame:
    """Minus the mean over time of each link and subcarrier, or a given (k, baseline)."""
    if baseline is None:
        return rows.withColumn(x, F.col(x) - F.avg(x).over(Window.partitionBy("link_id", "k")))
    joined = rows.join(baseline, "k", "left")
    checked = F.when(F.col("baseline").isNull(), F.raise_error(F.lit("baseline has another length")).cast("double")).otherwise(F.col("baseline"))
    return joined.withColumn(x, F.col(x) - checked).drop("baseline")


def amplitude_ratio(rows: DataFrame, x: str, reference: DataFrame | None = None) -> DataFrame:
    """Over the first frame of the link, or a given (k, reference); a reference of 0 gives 1."""
    if reference is None:
        r = rows.withColumn("_ref", F.first(x).over(over_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    else:
        r = rows.join(reference.withColumnRenamed("reference", "_ref"), "k", "left")
    return r.withColumn(x, F.when(F.col("_ref") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col(x), F.col("_ref")))).drop("_ref")


def check_window(w: int, stride: int) -> None:
    if w <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")


def windowed(rows: DataFrame, x: str, w: int, stride: int, aggregate, name: str) -> DataFrame:
    """An aggregate over full windows of w frames, every ``stride`` frames; ``w_idx`` counts windows
    from 0.  Blocks need a halo of w - 1 frames."""
    check_window(w, stride)
    rows = rows if "_pos" in rows.columns else rows.withColumn("_pos", F.row_number().over(over_time()) - 1)
    frame = over_time(rows).rowsBetween(-(w - 1), 0)
    halo = ["_halo"] if "_halo" in rows.columns else []
    out = rows.select("link_id", "k", "ts", "_pos", *halo, aggregate(F.col(x)).over(frame).alias(name))
    return _full_windows(out, w, stride).select("link_id", "k", "ts", "w_idx", name)


def _full_windows(rows: DataFrame, w: int, stride: int) -> DataFrame:
    """Rows that end a full window, each ``stride`` rows, with the window's number."""
    own = rows.where(~F.col("_halo")) if "_halo" in rows.columns else rows
    past = F.col("_pos") - (w - 1)
    return own.where((past >= 0) & (past % stride == 0)).withColumn("w_idx", (past / stride).cast("int"))


def sliding_window(frames: DataFrame, w: int, stride: int, block_rows: int | None = None) -> DataFrame:
    """(link_id, w_idx, ts_start, ts_end, frames): the frames of each full window, in order."""
    check_window(w, stride)
    blocks = in_blocks(frames.select("link_id", "ts", "amplitude", "phase"), ["link_id"], ["ts"], w - 1, block_rows)
    order = Window.partitionBy("link_id", "_block").orderBy("ts")
    held = F.collect_list(F.struct("ts", "amplitude", "phase")).over(order.rowsBetween(-(w - 1), 0))
    out = _full_windows(blocks.select("link_id", "_pos", "_halo", held.alias("frames")), w, stride)
    first, last = F.element_at("frames", 1)["ts"], F.element_at("frames", -1)["ts"]
    return out.select("link_id", "w_idx", first.alias("ts_start"), last.alias("ts_end"), "frames")


def ragged(frames: DataFrame) -> DataFrame:
    """Links whose frames differ in length."""
    return frames.groupBy("link_id").agg(F.count_distinct(F.size("amplitude")).alias("n")).where("n > 1").select("link_id")
