"""Recurrences and windows in chunks and blocks against plain loops and unsplit windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import features, preprocess, scan, sensing
from fieldlark.sources import tables


def looped(rows, a, init):
    """x of rows (key, order, value) with x = a(row) * x + b(row), key by key."""
    out, x, key = {}, None, None
    for k, t, v in sorted(rows):
        x = init(v) if k != key else x
        key = k
        x = a(v) * x + v
        out[k, t] = x
    return out


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_scan_of_numbers(spark, chunks):
    rng = random.Random(chunks)
    sizes = {"long": 900, "b": 1, "c": 40, "d": 300, "": 2}
    rows = [(k, t, rng.uniform(-1, 1)) for k, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rows, "key string, t int, v double").repartition(5)
    got = scan.scan_linear(df, ["key"], ["t"], F.when(F.col("v") > 0.9, 0.0).otherwise(0.97), F.col("v"), 5 * F.col("v"), "x", chunks)
    want = looped(rows, lambda v: 0.0 if v > 0.9 else 0.97, lambda v: 5 * v)
    assert got.columns == ["key", "t", "v", "x"]
    have = {(r.key, r.t): r.x for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_one_key_runs_in_many_tasks(spark):
    df = spark.range(4000).select(F.lit("only").alias("key"), "id", F.sin("id").alias("v"))
    out = scan.scan_linear(df, ["key"], ["id"], F.lit(0.9), 0.1 * F.col("v"), F.lit(0.0), "x", 16).withColumn("part", F.spark_partition_id())
    dealt = df.repartitionByRange(16, "key", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 8 and max(r["count"] for r in dealt) < 1000
    x, want = 0.0, []
    for k in range(4000):
        x = 0.9 * x + 0.1 * np.sin(k)
        want.append(x)
    assert np.allclose([r.x for r in out.orderBy("id").collect()], want, atol=1e-9, rtol=0)


def test_scan_of_vectors_and_of_nothing(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 3))
    rows = [("a" if t < 150 else "b", t, v[t].tolist()) for t in range(200)]
    df = spark.createDataFrame(rows, "key string, t int, v array<double>")
    got = scan.scan_linear(df, ["key"], ["t"], F.lit(0.97), F.transform("v", lambda x: 0.03 * x), F.col("v"), "x", 9)
    have, x = {r.t: r.x for r in got.collect()}, None
    for t in range(200):
        x = v[t] if t in (0, 150) else 0.97 * x + 0.03 * v[t]
        assert np.allclose(have[t], x, atol=1e-9, rtol=0)
    assert scan.scan_linear(df.where("false"), ["key"], ["t"], F.lit(1.0), F.lit(1.0), F.lit(0.0), "x").count() == 0


def made_frames(spark, sizes, width=5, seed=1):
    rng = random.Random(seed)
    rows = [(k, float(t), [rng.uniform(0, 2) for _ in range(width)], [rng.uniform(-4, 4) for _ in range(width)]) for k, n in sizes.items() for t in range(n)]
    return spark.createDataFrame(rows, "link_id string, ts double, amplitude array<double>, phase array<double>")


def same(a, b):
    key = lambda df: {tuple(r[c] for c in ("link_id", "k", "ts", "w_idx") if c in df.columns): r for r in df.collect()}
    x, y = key(a), key(b)
    assert x.keys() == y.keys() and len(x) > 0 and a.columns == b.columns
    for k in x:
        for u, v in zip(x[k], y[k]):
            assert u == pytest.approx(v, abs=1e-9) if isinstance(u, float) else u == v


def test_windows_in_blocks_equal_windows_of_whole_keys(spark):
    frames = made_frames(spark, {"long": 300, "short": 4, "other": 61}).persist()
    whole = tables.long(frames)
    blocks = lambda before, rows=30: tables.long(scan.in_blocks(frames, ["link_id"], ["ts"], before, rows))
    assert blocks(9).where("link_id = 'long' and not _halo").select("_block").distinct().count() == 10
    for order in (1, 2):
        same(preprocess.difference(blocks(order), "amp", order), preprocess.difference(whole, "amp", order))
    same(preprocess.unwrap_in_time(blocks(1), "phase"), preprocess.unwrap(whole, "phase", preprocess.over_time()))
    same(preprocess.windowed(blocks(9), "amp", 10, 5, F.var_pop, "v"), preprocess.windowed(whole, "amp", 10, 5, F.var_pop, "v"))
    same(preprocess.windowed(blocks(40, 3), "amp", 41, 7, F.sum, "v"), preprocess.windowed(whole, "amp", 41, 7, F.sum, "v"))  # a window longer than a block
    same(features.rolling_activity(blocks(10), "amp"), features.rolling_activity(whole, "amp"))
    same(preprocess.sliding_window(frames, 10, 3, block_rows=30), preprocess.sliding_window(frames, 10, 3))
    same(preprocess.windowed(blocks(9, None), "amp", 10, 5, F.avg, "v"), preprocess.windowed(whole, "amp", 10, 5, F.avg, "v"))
    assert preprocess.windowed(blocks(9).where("false"), "amp", 10, 5, F.avg, "v").count() == 0


def test_drift_by_scan_equals_the_fold(spark):
    sensed = sensing.sense_links(made_frames(spark, {"long": 120, "b": 1, "c": 15})).persist()
    got = {(r.link_id, r.ts): r for r in sensing.drift_scanned(sensed, chunks=12).collect()}
    assert len(got) == 136
    for r in sensed.collect():
        for name in ("drift_norm", "drift_common", "amplitude_delta", "phase_delta", "common_phase_delta", "common_amp_delta"):
            assert got[r.link_id, r.ts][name] == pytest.approx(r.drift[name], abs=1e-9)
