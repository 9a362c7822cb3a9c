"""Streams give what the batch folds give."""

from pyspark.sql import functions as F

from fieldlark.operators import sensing
from fieldlark.plans.pipeline import room_frames
from fieldlark.streaming import sensing as streaming


def test_sensing_stream_equals_batch(spark, tmp_path):
    frames = room_frames(spark, 12).persist()
    for k in range(3):
        frames.where((F.col("ts") > 0.2 * k + 0.001) & (F.col("ts") <= 0.2 * (k + 1) + 0.001)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streaming.sense_stream(streaming.frames_from_files(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("sensed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.link_id, round(r.ts, 3)): r.value for r in spark.table("sensed").collect()}
    want = {(r.link_id, round(r.ts, 3)): r.value for r in sensing.sense_links(frames).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tick_windows_wait_for_the_watermark(spark, tmp_path):
    rows = [("a", t * 0.5, 0.1 * t, 1.0, 1.0, 0.0, "NOMINAL") for t in range(20)]
    spark.createDataFrame(rows, streaming.EVIDENCE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(streaming.EVIDENCE).parquet(str(tmp_path / "in"))
    q = streaming.tick_windows(stream, 1.0).writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("ticks").orderBy("window").collect()
    assert [r.n for r in got] == [2] * len(got) and 5 <= len(got) <= 9


def test_tracking_stream(spark, tmp_path):
    cells = lambda x: [(i, x, 1.0) for i in range(3)]
    spark.createDataFrame([("room", float(t), cells(t)) for t in range(4)], "room string, ts double, cells array<struct<i:int,j:int,value:double>>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("room string, ts double, cells array<struct<i:int,j:int,value:double>>").parquet(str(tmp_path / "in"))
    q = streaming.track_stream(stream, (0.25, 0.25), (0.0, 0.0), 0.5, 2).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [list(r.ids) for r in spark.table("tracked").orderBy("ts").collect()] == [[1]] * 4


def test_publisher(spark):
    got = []

    def broken(_):
        raise ConnectionError

    p = streaming.Publisher([got.append, broken])
    batch = spark.createDataFrame([(2.0, "b"), (1.0, "a")], "ts double, message string")
    p.publish(batch, 0)
    assert got == ["a", "b"] and len(p.clients) == 1 and p.receive("ping") == "pong" and p.latest == "b"
    one = streaming.Publisher([got.append], single=True)
    one.connect(print)
    assert one.clients == [print]


def test_publisher_drops_silent_clients_and_tells_its_status(spark):
    now, got = [0.0], []
    p = streaming.Publisher(timeout=30, clock=lambda: now[0])
    first, second = (lambda m: got.append(("first", m))), (lambda m: got.append(("second", m)))
    p.connect(first)
    p.connect(second)
    assert p.status() == {"clients": 2, "published": 0, "state": None}
    now[0] = 20.0
    assert p.receive("ping", first) == "pong" and p.receive("hello", first) is None
    now[0] = 40.0
    p.publish(spark.createDataFrame([(1.0, '{"a": 1}')], "ts double, message string"), 0)
    assert got == [("first", '{"a": 1}')] and p.status() == {"clients": 1, "published": 1, "state": {"a": 1}}
