"""Fusion behaviour, fields, regions, tracking, validation."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark import config as C
from fieldlark.functions import predicates as V
from fieldlark.operators import cluster, fusion, grid, latent, synthetic, tracking, world
from fieldlark.sources import tables

SETTINGS = replace(C.ServerConfig(), decay=0.85, enter_threshold=0.10, exit_threshold=0.06, persistence=2, min_activity=0.0)


def links(spark, *names):
    ends = {"a": ((-4.5, 0.0, 1.5), (4.5, 0.0, 1.5)), "b": ((0.0, -4.5, 1.5), (0.0, 4.5, 1.5)), "c": ((-4.5, 3.0, 1.5), (4.5, 3.0, 1.5))}
    return spark.createDataFrame([(n, *ends[n], 5.8e9) for n in names], C.LINK_GEOMETRY)


def play(spark, names, rows):
    """Fields (tick, 40, 40) of activity and confidence for evidence rows."""
    ev = spark.createDataFrame(rows, C.LINK_EVIDENCE)
    got = fusion.persist(fusion.fuse(links(spark, *names), tables.grid(spark), ev, SETTINGS), SETTINGS).toPandas().sort_values(["ts", "i", "j"])
    shape = (got.ts.nunique(), 40, 40)
    return got.value.to_numpy().reshape(shape), got.confidence.to_numpy().reshape(shape)


def spread(field):
    i, j = np.mgrid[0:40, 0:40]
    w = field / field.sum()
    return [float(np.sqrt((w * (x - (w * x).sum()) ** 2).sum())) for x in (i, j)]


def test_one_link_is_elongated_and_two_tighten(spark):
    one, _ = play(spark, "a", [(float(t), "a", 1.0, 1.0, 1.0) for t in range(6)])
    sx, sy = spread(one[-1])
    assert sx > 1.4 * sy and (one[-1] > 0.2).sum() > 20 and one[-1].max() < 0.9
    two, _ = play(spark, "ab", [(float(t), n, 1.0, 1.0, 1.0) for t in range(6) for n in "ab"])
    assert (two[-1] > 0.1).sum() < (one[-1] > 0.1).sum() and two[-1][2, 20] <= 0.5 * one[-1][2, 20]


def test_unhealthy_links_are_gated(spark):
    ev = spark.createDataFrame([(0.0, "a", 1.0, 1.0, 1.0), (0.0, "b", 1.4, 0.10, 1.0), (0.0, "x", 1.0, 1.0, 1.0)], C.LINK_EVIDENCE)
    row = fusion.link_weights(fusion.gate(links(spark, "a", "b", "c"), ev, SETTINGS)).first()
    assert row.link_weights == {"a": 1.0, "b": 0.0} and list(row.active_links) == ["a"]


def test_no_evidence_gives_an_empty_field(spark):
    v, c = play(spark, "ab", [(0.0, "a", 0.0, 1.0, 1.0)])
    assert v.shape == (1, 40, 40) and not v.any() and not c.any()


def test_replay_is_deterministic(spark):
    rows = [(float(t), n, 0.5 + 0.5 * np.sin(t + k), 0.9, 0.8) for t in range(12) for k, n in enumerate("ab")]
    rows = [(a, b, float(max(0, x)), d, e) for a, b, x, d, e in rows]
    assert np.allclose(play(spark, "ab", rows)[0], play(spark, "ab", rows[::-1])[0], atol=1e-12)


def test_hysteresis_keeps_and_drops():
    state, out = (0.0, 0, False), []
    for x in [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]:
        state = fusion.hold_step(state, x, SETTINGS)
        out.append(state[2])
    assert out[:4] == [False, True, True, True] and not out[-1]


def test_grid_lookup(spark):
    field = spark.range(100).selectExpr("cast(id div 10 as int) i", "cast(id % 10 as int) j", "cast(id as double) value")
    points = spark.createDataFrame([(5.5, 5.5), (-0.5, 3.0), (-1.5, 3.0), (100.0, 1.0)], "x double, y double")
    got = {r.x: (r.i, r.value) for r in grid.value_at(points, field, (0.0, 0.0), 1.0, (10, 10)).collect()}
    assert got == {5.5: (5, 55.0), -0.5: (0, 3.0), -1.5: (None, None), 100.0: (None, None)}
    with pytest.raises(IndexError):
        grid.slice_at(field, "z", 9, 5)
    with pytest.raises(ValueError):
        grid.project(field, "z", "median")


def test_voxel_shapes(spark):
    v = tables.voxel_grid(spark, (4.0, 4.0, 2.0), (-2.0, -2.0, 0.0), 0.5)
    assert v.count() == 8 * 8 * 4 and v.agg(F.min("x")).first()[0] == -1.75
    assert tables.voxel_grid(spark, (0.1, 0.1, 0.1), (0.0, 0.0, 0.0), 0.5).count() == 1


def test_projection_confidence_takes_the_first_of_a_tie(spark):
    v = spark.createDataFrame([(0, 0, 0, 2.0, 0.1), (0, 0, 1, 2.0, 0.9), (0, 0, 2, 1.0, 0.5)], "i int, j int, k int, value double, confidence double")
    assert grid.project_floor(v).first().confidence == 0.1 and grid.project_floor(v, "mean").first().confidence == pytest.approx(0.5)


def test_set_decay_clear_accumulate(spark):
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, value double")
    up = spark.createDataFrame([(0, 1, 5.0), (3, 3, 7.0)], "i int, j int, value double")
    assert {(r.i, r.j): r.value for r in grid.set_values(f, up, ("i", "j")).collect()} == {(0, 0): 1.0, (0, 1): 5.0, (3, 3): 7.0}
    assert grid.decay(f, 0.5).agg(F.sum("value")).first()[0] == 1.5 and grid.clear(f).agg(F.sum("value")).first()[0] == 0
    assert grid.accumulate(f, up, 2.0).agg(F.sum("value")).first()[0] == 13.0


def test_moving_object_bounces(spark):
    one = spark.createDataFrame([("m", "moving", 0.0, 0.0, 1.0, 1.0, 0.5, 1.0, 1.0, 0.0, 0.0, -0.25, 0.25, -9.0, 9.0)], C.DISTURBANCE)
    x = [r.x for r in world.at_ticks(one, 5, 0.1).orderBy("tick").collect()]
    assert x == pytest.approx([0.1, 0.2, 0.25, 0.15, 0.05])
    with pytest.raises(ValueError):
        world.at_ticks(one, 1, -0.1)


def test_noise_has_its_moments(spark):
    r = spark.range(20000).select(synthetic.normal(3, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03


@pytest.mark.parametrize("connectivity", [4, 8])
def test_region_ways_agree(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    a = rng.random((12, 12)) * (rng.random((12, 12)) < 0.5)
    rows = [(1.0, i, j, float(a[i, j])) for i in range(12) for j in range(12)]
    f = spark.createDataFrame(rows, "ts double, i int, j int, value double")
    big = cluster.find_regions(f, 0.1, 2, connectivity, ("ts",)).orderBy("rank").collect()
    small = cluster.find_regions_per_tick(f, 0.1, 2, connectivity).orderBy("rank").collect()
    assert [(r.rank, r.size) for r in big] == [(r.rank, r.size) for r in small]
    assert np.allclose([(r.centroid_row, r.centroid_col) for r in big], [(r.centroid_row, r.centroid_col) for r in small])
    with pytest.raises(ValueError):
        cluster.label_regions(f, connectivity=6)


def test_tracker():
    c = lambda x, y, a=0.5: {"x": x, "y": y, "radius": 0.3, "activity": a}
    s, e = tracking.track(None, [c(0, 0), c(3, 0)], 1.0)
    assert [x["id"] for x in e] == [1, 2] and e[0]["stability"] == 0.5
    s, e = tracking.track(s, [c(3.1, 0), c(0.2, 0)], 2.0)
    assert [(x["id"], x["x"]) for x in e] == [(1, 0.2), (2, 3.1)] and e[0]["last_change"] == 1.0 and e[0]["frames_tracked"] == 2
    s, e = tracking.track(s, [c(5.0, 0)], 3.0)
    assert [x["id"] for x in e] == [3] and e[0]["last_change"] == 3.0
    assert tracking.candidates([{"centroid_row": 4.0, "centroid_col": 2.0, "size": 400, "total_intensity": 900.0}], (0.25, 0.25), (-5.0, -5.0)) == [{"x": -4.0, "y": -4.5, "radius": 2.0, "activity": 1.0}]


def test_detections_to_2d_and_predict(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 1.0, 1.0, 1.0, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None)], C.DETECTION_3D)
    assert list(tracking.detection_to_2d(d).first().bbox) == [0.0, 1.0, 3.0, 4.0]
    t = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.0, "CONFIRMED", (1.0, 2.0, 3.0), 1, 1, 0, [(0.0, 1.0, 1.0, 1.0)])], C.TRACK_3D)
    flat = tracking.track_to_2d(t)
    r = tracking.predict(flat, 1.0).first()
    assert (r.x, r.y) == (2.0, 3.0) and flat.where(tracking.is_confirmed()).count() == 1
    assert tracking.predict(t, 2.0, "xyz").first().z == 7.0


def test_validation(spark):
    rows = [("a", 0.0, [1.0], [0.0], {}), ("", 0.0, [1.0], [0.0], {}), ("a", float("inf"), [1.0], [0.0], {}), ("a", 0.0, [1.0, 2.0], [0.0], {}), ("a", 0.0, [float("nan")], [0.0], {}), (" ", 0.0, [1.0], [1.0], {}), ("a", None, None, None, None)]
    df = spark.createDataFrame(rows, C.FRAME)
    good, bad = V.quarantine(df, V.frame_faults())
    assert good.count() == 2 and sorted(r.fault for r in bad.collect())[0] == "amplitude and phase differ in length" and bad.count() == 5
    assert V.enforce(good, V.frame_faults()).count() == 2
    with pytest.raises(Exception, match="link_id is empty"):
        V.enforce(df.where("link_id = ''"), V.frame_faults()).collect()
    m = spark.createDataFrame([("l", 1.0, 42.5, None, "dB", (1.0, 0.8, 0.9, 0.7, 0.1), {}), ("l", 1.0, None, [1.0, 2.0], "dB", (1.0, 1.5, 0.9, 0.7, 0.1), {}), ("l", 1.0, 1.0, [1.0], "dB", (1.0, 0.5, 0.9, 0.7, 0.1), {})], C.MEASUREMENT)
    assert [r.fault for r in m.select(V.first_fault(V.measurement_faults()).alias("fault")).collect()] == [None, "confidence is outside [0, 1]", "not one of value and vector"]
    assert m.select(V.combined_quality().alias("q")).first().q == pytest.approx(0.8 * 0.9 * 0.7 * 0.9)
    e = spark.createDataFrame([(0.0, " ", 1.0, 1.0, 1.0), (0.0, "a", -1.0, 1.0, 1.0), (0.0, "a", 1.0, 2.0, 1.0)], C.LINK_EVIDENCE)
    assert V.quarantine(e, V.evidence_faults())[0].count() == 0 and V.quarantine(links(spark, "a"), V.geometry_faults())[0].count() == 1
    t = spark.createDataFrame([(0, 1.0, 1.0, 0.0, "CONFIRMED", None, 1, 1, 0, None), (1, 1.0, 1.0, 0.0, "GONE", None, 1, 1, 0, None), (1, 1.0, 1.0, 0.0, "DELETED", None, 1, 1, 0, None)], C.TRACK_2D)
    assert V.quarantine(t, V.track_faults())[0].count() == 1
    with pytest.raises(TypeError):
        V.require_columns(t, track_id="string")
    assert spark.range(1).select(V.has_shape(F.expr("array(array(1,2),array(3,4))"), (None, 2)).alias("s")).first().s
    with pytest.raises(Exception, match="scalar"):
        m.where("vector is not null and value is null").select(V.as_float()).collect()


def test_adapters(spark):
    legacy = spark.createDataFrame([(0.5, [1.0], [0.0])], "timestamp double, amplitude array<double>, phase array<double>")
    assert tables.as_frame(legacy).first().link_id == "default"
    made = tables.as_frame(legacy.selectExpr("timestamp", "amplitude amplitudes", "phase phases"), source="synthetic").first()
    assert made.link_id == "synthetic" and made.meta == {"source": "synthetic"}
    raw = tables.from_raw(tables.as_frame(legacy), F.transform("amplitude", lambda x: x * 2), F.col("phase"), "double").first()
    assert raw.amplitude == [2.0] and raw.amplitude_raw == [1.0] and raw.conditioning_method == "double"
    assert tables.to_legacy(tables.as_frame(legacy)).columns == ["timestamp", "amplitude", "phase"]


def test_encoders(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, x array<double>")
    p = latent.PCAEncoder(6, 2)
    with pytest.raises(RuntimeError):
        p.encode(F.col("x"))
    p.fit(df, "x")
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(p.explained_variance, (s**2 / 199)[:2]) and np.allclose(np.abs(p.components), np.abs(vt[:2].T), atol=1e-6)
    assert np.allclose([r.z for r in df.orderBy("idx").select(p.encode(F.col("x")).alias("z")).collect()], (x - x.mean(axis=0)) @ p.components)
    e = latent.LinearEncoder(6, 3, seed=1)
    assert np.allclose(e.weights.T @ e.weights, np.eye(3))
    with pytest.raises(ValueError):
        latent.LinearEncoder(3, 4)
    m = latent.MLPEncoder(6, 4, 2, seed=2)
    assert np.allclose([r.z for r in df.orderBy("idx").select(m.encode(F.col("x")).alias("z")).collect()], np.tanh(x @ m.weights1 + m.bias1) @ m.weights2 + m.bias2)


def test_k_means(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, x array<double>")
    assigned, centers = cluster.k_means(df, 3, seed=4)
    assert sorted(r["size"] for r in cluster.latent_clusters(assigned, centers).collect()) == [40, 40, 40]
    assert cluster.optimal_k(df, (2, 4), seed=4)[0] == 3
    empty = cluster.latent_clusters(*cluster.k_means(df, 2, np.array([[0.0, 0.0], [900.0, 900.0]]), max_iter=1)).collect()
    assert {r.cluster_id: r["size"] for r in empty} == {0: 120, 1: 0}
    with pytest.raises(ValueError):
        cluster.k_means(df.withColumn("x", F.array(F.lit(1.0))), 2)
