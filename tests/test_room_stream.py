"""The continuous pipeline against the batch plan: the same messages, restarts, late, odd and missing frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldlark.config import ServerConfig
from fieldlark.operators import message, sensing
from fieldlark.plans.pipeline import rooms_messages
from fieldlark.sources import tables
from fieldlark.streaming import room

FRAME = "room string, link_id string, ts double, amplitude array<double>, phase array<double>"
#: So that a few ticks have regions and entities.
EAGER = ServerConfig(persistence=1, enter_threshold=0.03, exit_threshold=0.02, cluster_threshold=0.01)


def made_frames(ticks, rooms=2, width=16, seed=3):
    rng = random.Random(seed)
    rows = []
    for t in range(ticks):
        for r in range(rooms):
            for k in range(3):
                a = [1 + 0.1 * rng.random() for _ in range(width)]
                rows.append((f"room_{r}", f"link_{k}", round((t + 1) * 0.05, 3), a, [x * (2 + t % 3) for x in a]))
    return rows


def arrive(spark, rows, path):
    spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, marks):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", marks).start()
    q.processAllAvailable()
    return q


def near(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(near(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(near, a, b))
    return abs(a - b) < 1e-9 if isinstance(a, float) else a == b


def test_stream_of_messages_equals_the_batch(spark):
    rows = made_frames(12)
    odd = [("room_0", "link_0", 0.101, None, [1.0]), ("room_0", "link_1", 0.101, [1.0, 2.0], [1.0]), ("room_1", "link_1", 0.101, [], []), ("room_1", "link_2", 0.101, [1.0] * 16, [float("nan")] * 16), ("room_1", "link_0", 0.15, [1.0] * 3, [1.0] * 3)]
    frames = spark.createDataFrame(rows + odd, FRAME)
    links = tables.default_links(spark)
    got = room.replayed(frames, lambda arriving: room.message_stream(arriving, links, EAGER), arrivals=3)
    got = {(r.room, r.ts): json.loads(r.message) for r in got.select("room", "ts", "message").collect()}
    want = {(r.room, r.ts): json.loads(r.message) for r in rooms_messages(frames, EAGER).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    assert all(near(want[k], got[k]) for k in want)
    assert sum(len(m["entities"]) for m in got.values()) > 10


def test_stream_goes_on_after_a_restart_and_drops_what_is_late(spark, tmp_path):
    rows, inbox, marks = made_frames(30, rooms=1), str(tmp_path / "in"), str(tmp_path / "marks")
    scattered = rows[:]
    random.Random(1).shuffle(scattered)
    early, later = [r for r in scattered if r[2] <= 0.5], [r for r in scattered if r[2] > 0.5]
    read = lambda: spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(inbox)
    arrive(spark, early, inbox)
    out = str(tmp_path / "out")

    def go_on():
        q = room.link_stream(read(), late="200 milliseconds").writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return q

    go_on()
    first = spark.read.parquet(out).collect()
    arrive(spark, later, inbox)
    arrive(spark, [("room_0", "link_0", 0.001, [1.0] * 16, [1.0] * 16), ("room_0", "link_1", 0.002, [9.0] * 16, [1.0] * 16)], inbox)
    arrive(spark, [(room.HEARTBEAT, room.HEARTBEAT, 500.0, None, None)], inbox)
    assert room.late_rows(go_on()) == 2
    got = {(r.link_id, r.ts): (r.value, r.drift_common) for r in spark.read.parquet(out).collect()}
    want = {(r.link_id, r.ts): (r.value, r.drift["drift_common"]) for r in sensing.sense_links(spark.createDataFrame(rows, FRAME)).collect()}
    assert 0 < len(first) < len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_silent_key_is_forgotten(spark, tmp_path):
    inbox = str(tmp_path / "in")
    frame = lambda ts, x: ("room", "link_0", ts, [1.0, x, 2.0], [0.0, 0.1, 0.2])
    for rows in ([frame(1.0, 1.5), frame(1.1, 1.7)], [(room.HEARTBEAT, room.HEARTBEAT, 50.0, None, None)], [frame(60.0, 1.9)], [(room.HEARTBEAT, room.HEARTBEAT, 90.0, None, None)]):
        arrive(spark, rows, inbox)
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(inbox)
    run(room.link_stream(stream, forget=10.0), "silent", str(tmp_path / "marks")).stop()
    got = {r.ts: r.measure_meta["window_size"] for r in spark.table("silent").collect()}
    assert got == {1.0: 1.0, 1.1: 2.0, 60.0: 1.0}  # a link that comes again begins anew


def test_names_of_links_are_escaped(spark):
    links = spark.createDataFrame([('a"b\\', '{"x": 1}')], "link_id string, doc string").select(F.map_from_arrays(F.array("link_id"), F.array("doc")).alias("links"))
    rows = links.select(
        F.lit(1.0).alias("ts"), F.expr("cast(array() as array<struct<id:bigint>>)").alias("entities"), *[F.lit(0.0).alias(n) for n in ("total_activity", "novelty", "env_drift", "fps", "latency_ms")],
        F.lit("NOMINAL").alias("csi_health"), message.empty_field().alias("field"), F.expr("cast(array() as array<struct<size:bigint>>)").alias("clusters"), "links",
    )
    assert json.loads(message.with_documents(rows, 1).first().message)["intermediate"]["links"] == {'a"b\\': {"x": 1}}
