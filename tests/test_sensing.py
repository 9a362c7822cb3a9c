"""Conditioning, drift and measurement: behaviour of the sensing stage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.config import ServerConfig
from fieldlark.operators import sensing
from fieldlark.operators.fold import fold_columns, fold_sorted
from fieldlark.plans.pipeline import room_messages


def run(frames):
    state, out = None, []
    for a, p in frames:
        state, o = sensing.sense(state, {"amplitude": a, "phase": p})
        out.append(o)
    return out


def test_wrapped_phase_stays_continuous():
    true = [np.linspace(0, 3 * math.pi, 64) + 0.4 * t for t in range(12)]
    state, last, jumps = None, None, []
    for p in true:
        state, o = sensing.condition(state, np.ones(64) + 0.1 * np.sin(np.arange(64)), (p + math.pi) % (2 * math.pi) - math.pi)
        if last is not None:
            jumps.append(np.abs(o["phase"] - last).mean())
        last = o["phase"]
    assert np.mean(jumps) < 2.0


def test_outliers_become_the_mean():
    a = np.ones(64)
    a[10] = 1000.0
    p = np.zeros(64)
    p[5] = 40.0
    _, o = sensing.condition(None, a, p)
    assert abs(o["amplitude"].mean()) < 0.3 and o["health"]["outlier_ratio"] > 0 and o["health"]["status"] != "NOMINAL"


def test_drift_is_zero_first_small_unchanged_and_larger_changed():
    a, p = np.linspace(1, 2, 64), np.sin(np.linspace(0, 3, 64))
    same = run([(a, p), (a, p), (a * 1.5 + 0.3, p + 0.8)])
    assert same[0]["drift"]["drift_norm"] == 0 and same[1]["drift"]["drift_norm"] < 0.05 < same[2]["drift"]["drift_norm"]
    assert same[0]["value"] == 0 and same[0]["measure_meta"]["window_size"] == 1


def test_measurement_window_is_bounded():
    rng = np.random.default_rng(0)
    out = run([(1 + 0.1 * rng.random(8), rng.random(8)) for _ in range(25)])
    assert out[-1]["measure_meta"]["window_size"] == 10
    assert all(0 <= o["quality"]["confidence"] <= 1 for o in out)


def test_moving_scene_is_more_active_than_a_still_one(spark):
    from fieldlark import config as C
    from fieldlark.operators import synthetic, world
    from fieldlark.sources import tables

    link = spark.createDataFrame([("a", (-4.5, 0.0, 1.5), (4.5, 0.0, 1.5), 5.8e9)], C.LINK_GEOMETRY)
    walker = spark.createDataFrame([("w", "moving", 0.0, -3.0, 1.5, 0.0, 1.4, 1.1, 1.5, 0.0, 0.0, -4.0, 4.0, -3.5, 3.5)], C.DISTURBANCE)
    motion = world.path_disturbance(link, world.at_ticks(walker, 80, 0.05))
    still = motion.withColumn("disturbance", F.lit(0.0))

    def activity(path):
        rows = tables.pack(synthetic.generate(link, path, 0.05, sigma_amp=0.003, sigma_phase=0.015, seed=7), "amp", "phase")
        frames = rows.select("link_id", "ts", F.col("amp").alias("amplitude"), "phase")
        return sensing.sense_links(frames).where("ts > 1.0").agg(F.avg("value")).first()[0]

    quiet, busy = activity(still), activity(motion)
    assert quiet < 0.03 and busy > quiet + 0.003 and busy > 3 * quiet


def test_fold_keeps_order_and_keys_apart(spark):
    rows = [(k, t, float(t)) for k in "ab" for t in range(50)]
    df = spark.createDataFrame(rows[::-1], "k string, t int, v double").repartition(5)
    got = fold_sorted(df, ["k"], ["t"], lambda s, r: ((s or 0.0) + r["v"],) * 2 and ((s or 0.0) + r["v"], {"s": (s or 0.0) + r["v"]}), "s double")
    assert {(r.k, r.t): r.s for r in got.collect()} == {(k, t): t * (t + 1) / 2 for k in "ab" for t in range(50)}


def test_messages(spark):
    import json

    docs = [json.loads(r.message) for r in room_messages(spark, 12).collect()]
    assert len(docs) == 12
    for d in docs:
        assert set(d) == {"timestamp", "entities", "global", "system", "field", "intermediate"}
        f = d["field"]
        assert len(f["data"]) == len(f["confidence_data"]) == f["width"] * f["height"] == 1600
        assert set(d["intermediate"]) == {"cluster_count", "clusters", "links"} and set(d["intermediate"]["links"]) == {"link_0", "link_1", "link_2"}
        one = d["intermediate"]["links"]["link_0"]
        assert set(one) == {"geometry", "health", "measurement", "drift"} and one["geometry"]["wavelength_m"] == pytest.approx(299792458 / 5.8e9)
    assert max(max(d["field"]["data"]) for d in docs) > 0


def test_config_is_checked():
    with pytest.raises(ValueError):
        ServerConfig(enter_threshold=0.1, exit_threshold=0.2)
    with pytest.raises(ValueError):
        ServerConfig(dt=0)


def test_column_folds_keep_order_keys_and_nulls(spark):
    rows = [(k, t, None if t % 7 == 3 else float(t)) for k in "ab" for t in range(50)]
    df = spark.createDataFrame(rows[::-1], "k string, t int, v double").repartition(5)
    step = lambda s, v: (((s or 0.0) + (v or 0.0)),) * 2
    got = fold_columns(df, ["k"], ["t"], ["v"], lambda s, v: (step(s, v)[0], (step(s, v)[0], v is None)), "s double, gone boolean").collect()
    want = {(k, t): (sum(x for x in range(t + 1) if x % 7 != 3), t % 7 == 3) for k in "ab" for t in range(50)}
    assert {(r.k, r.t): (r.s, r.gone) for r in got} == want
    assert fold_columns(df.limit(0), ["k"], ["t"], ["v"], lambda s, v: (s, (0.0, True)), "s double, gone boolean").count() == 0


def test_persistence_streams_long_histories(spark):
    from fieldlark.operators import fusion

    c, rng = ServerConfig(), np.random.default_rng(3)
    rows = [(float(t), i, 0, float(v), 0.5) for i in range(3) for t, v in enumerate(rng.random(3000) ** 3)]
    df = spark.createDataFrame(rows, "ts double, i int, j int, value double, confidence double").repartition(4)
    got = {(r.ts, r.i): (r.value, r.active) for r in fusion.persist(df, c).collect()}
    for i in range(3):
        f, n, on = 0.0, 0, False
        for t, k, _, v, _ in rows:
            if k == i:
                f = c.decay * f + (1 - c.decay) * v
                n = n + 1 if f >= c.enter_threshold else 0
                on = n >= c.persistence or on and f >= c.exit_threshold
                assert got[t, i] == (pytest.approx(f) if on else 0.0, on)


def test_tracker_against_plain_matching(spark):
    """Rooms in parallel, each as a plain loop over its ticks would have it."""
    from fieldlark.operators import tracking

    rng, rows = np.random.default_rng(9), []
    for room in "abc":
        spots = rng.uniform(0, 40, (4, 2))
        for t in range(25):
            spots = spots + rng.normal(0, 1.5, spots.shape)
            seen = [(float(x), float(y), int(rng.integers(1, 60)), float(rng.uniform(0, 50))) for x, y in spots if rng.random() < 0.8]
            rows.append((room, float(t), seen))
    kind = "array<struct<centroid_row:double,centroid_col:double,size:bigint,total_intensity:double>>"
    df = spark.createDataFrame(rows, f"room string, ts double, clusters {kind}").repartition(3)
    got = {(r.room, r.ts): [tuple(e) for e in r.entities] for r in tracking.track_rooms(df, (0.25, 0.25), (-5.0, -5.0)).collect()}
    for room in "abc":
        alive, names = {}, 0
        for _, t, seen in sorted(r for r in rows if r[0] == room):
            spots = [(-5 + r * 0.25, -5 + c * 0.25, max(0.3, min(2.0, math.sqrt(n) * 0.125)), min(1.0, w / max(n, 1))) for r, c, n, w in seen]
            taken, after = set(), {}
            for name, old in alive.items():
                best = None
                for k, s in enumerate(spots):
                    d = math.hypot(old["x"] - s[0], old["y"] - s[1])
                    if k not in taken and d < 1.5 and (best is None or d < best[0]):
                        best = (d, k)
                if best:
                    d, k = best
                    taken.add(k)
                    x, y, radius, activity = spots[k]
                    news = d > 0.3 or abs(activity - old["activity"]) > 0.2
                    after[name] = {"x": x, "y": y, "activity": activity, "stability": 0.7 * max(0.0, 1 - 0.5 * d) + 0.3 * old["stability"], "last": t if news else old["last"], "radius": radius, "n": old["n"] + 1}
            for k, (x, y, radius, activity) in enumerate(spots):
                if k not in taken:
                    names += 1
                    after[names] = {"x": x, "y": y, "activity": activity, "stability": 0.5, "last": t, "radius": radius, "n": 1}
            alive = after
            want = [(name, e["x"], e["y"], 0.0, e["activity"], e["stability"], e["last"], e["radius"], e["n"]) for name, e in alive.items()]
            assert [e[0] for e in got[room, t]] == [e[0] for e in want]
            assert [x for e in got[room, t] for x in e] == pytest.approx([x for e in want for x in e])


def test_update_loop_goes_on_where_it_was(spark):
    from fieldlark.operators import world
    from fieldlark.plans.update_loop import UpdateLoop
    from fieldlark.sources import tables

    links, objects = tables.default_links(spark), tables.default_objects(spark)
    loop = UpdateLoop(links, objects)
    parts = [loop.run(3), loop.step(), loop.run(2)]
    at = lambda df: {(r.object_id, r.tick): (r.x, r.y, r.intensity) for r in df.collect()}
    got = {k: v for p in parts for k, v in at(p.objects).items()}
    want = at(world.at_ticks(objects, 6, 0.05))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert loop.step_count == 6 and loop.current_time == pytest.approx(0.3) and parts[0].frames.count() == 9 and parts[0].field is None
    with pytest.raises(TypeError):
        loop.add_objects(objects.drop("radius"))
    with pytest.raises(TypeError):
        loop.set_voxel_grid(objects)


def test_rates_come_from_wall_clocks(spark):
    import json

    walls = spark.createDataFrame([(round(0.05 * (k + 1), 10), 125_000 * k, 7.0) for k in range(12)], "ts double, wall_us bigint, latency_ms double")
    walls = walls.withColumn("ts", F.col("ts"))
    docs = [json.loads(r.message) for r in room_messages(spark, 12, walls=walls).orderBy("ts").collect()]
    assert all("frames_tracked" not in e for d in docs for e in d["entities"])
    paced = [d["system"] for d in docs if d["system"]["fps"]]
    assert paced and all(1 <= s["fps"] <= 9 and s["latency_ms"] == 7.0 for s in paced)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from fieldlark.operators import lineage

    none = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(SimpleNamespace(sparkContext=sc, conf={}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(**{**vars(sc), "master": "local-cluster[2,2,1024]"}), conf={}))


def test_rooms_do_not_mix(spark):
    """A room's messages are the same alone and among others."""
    from fieldlark.plans.pipeline import room_frames, rooms_messages

    one, two = room_frames(spark, 6, seed=1), room_frames(spark, 6, seed=2)
    both = one.withColumn("room", F.lit("a")).unionByName(two.withColumn("room", F.lit("b")))
    got = {(r.room, r.ts): r.message for r in rooms_messages(both).collect()}
    assert len(got) == 12 and {r.ts: r.message for r in room_messages(spark, 6, frames=two).collect()} == {t: m for (room, t), m in got.items() if room == "b"}
