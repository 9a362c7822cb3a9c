"""Queries over the contracts of records: shapes and types, validators, adapters, record forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions import predicates as V
from fieldlark.functions import variant
from fieldlark.operators import fusion, preprocess, sensing, tracking, world
from fieldlark.operators import records as R
from fieldlark.operators.lineage import Rounds
from fieldlark.operators.quarantine import split_once
from fieldlark.plans.frame_queries import FRAMES, STRIDE, W, r, rounded
from fieldlark.plans.room_queries import _EVID, _KERNEL, evidence
from fieldlark.plans.update_loop import UpdateLoop
from fieldlark.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _how_many(**conditions: Column) -> list[Column]:
    return [F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()]


def _faults(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """Rows counted by their first fault."""
    return df.select(F.coalesce(V.first_fault(faults), F.lit("sound")).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FRAMES}, s AS (SELECT a, CASE WHEN ts % 5 = 0 THEN a[1:8] WHEN ts % 5 = 1 THEN [] WHEN ts % 5 = 2 THEN NULL ELSE a END AS b FROM f)
SELECT count(*) FILTER (WHERE len(a) = 64) AS whole, count(*) FILTER (WHERE len(b) = 8) AS eight, count(*) FILTER (WHERE b IS NOT NULL) AS any_length, count(*) FILTER (WHERE len(b) = 64) AS pairs_of_any_length,
count(*) FILTER (WHERE len(b) > 0) AS filled, count(*) FILTER (WHERE len(a) = len(b)) AS same FROM s"""
)
def shapes(spark, sf):
    """Lengths with and without a wild card, nested shapes, emptiness."""
    t = F.col("ts") % 5
    f = tables.frames(spark, sf).withColumn("b", F.when(t == 0, F.slice("amplitude", 1, 8)).when(t == 1, F.slice("amplitude", 1, 0)).when(t != 2, F.col("amplitude")))
    a, b, both = F.col("amplitude"), F.col("b"), F.array("b", "b")
    return f.agg(*_how_many(whole=V.has_length(a, 64), eight=V.has_length(b, 8), any_length=V.has_length(b, None), pairs_of_any_length=V.has_shape(both, (2, None)) & V.has_shape(both, (None, 64)), filled=V.non_empty(b), same=V.same_shape(a, b)))


@query("SELECT * FROM (VALUES ('amplitude', 1, 'array<double>', true), ('link_id', 0, 'string', true), ('phase', 1, 'array<double>', true), ('ts', 0, 'double', true)) t(name, dimensions, kind, as_wanted)")
def types_and_dimensions(spark, sf):
    """Types and dimensions of the frame contract, checked against the schema alone."""
    f = tables.frames(spark, sf)
    wanted = {"link_id": "string", "ts": "double", "amplitude": "array<double>", "phase": "array<double>"}
    checked = V.require_columns(f, **wanted)
    rows = [(n, V.dimensions(checked, n), k, V.is_of_type(checked, n, k, "array<float>")) for n, k in wanted.items()]
    return spark.createDataFrame(rows, "name string, dimensions int, kind string, as_wanted boolean")


_M = "event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'link' END AS link_id, CASE WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN 'inf'::DOUBLE ELSE value END AS value, event_id % 7 IN (1, 3) AS vector, CASE WHEN event_id % 11 = 4 THEN '' ELSE 'dB' END AS unit, ((event_id * 3) % 103) / 100.0::DOUBLE AS confidence"


@query(
    f"""WITH m AS (SELECT {_M} FROM events)
SELECT CASE WHEN link_id IS NULL THEN 'link_id is empty' WHEN (value IS NULL) <> vector THEN 'not one of value and vector' WHEN value IS NOT NULL AND NOT isfinite(value) THEN 'value is not finite'
WHEN unit = '' THEN 'unit is empty' WHEN confidence > 1 THEN 'confidence is outside [0, 1]' ELSE 'sound' END AS fault, count(*) AS n FROM m GROUP BY 1"""
)
def validate_measurements(spark, sf):
    return _faults(_measurements(spark, sf), V.measurement_faults())


def _measurements(spark, sf) -> DataFrame:
    e = tables.read(spark, sf, "events")
    i, x = F.col("event_id"), F.col("value")
    part = lambda c: c.cast("double")
    quality = F.struct(F.lit(30.0).alias("snr"), part(((i * 3) % 103) / 100.0).alias("confidence"), F.lit(1.0).alias("completeness"), F.lit(1.0).alias("stability"), F.lit(0.0).alias("outlier_score"))
    m = e.select(
        F.when(i % 17 != 0, "link").alias("link_id"), F.lit(0.0).alias("ts"), F.when(i % 7 == 2, F.lit(float("inf"))).when(i % 7 != 1, x).alias("value"),
        F.when((i % 7).isin(1, 3), F.array(x)).alias("vector"), F.when(i % 11 == 4, "").otherwise("dB").alias("unit"), quality.alias("quality"),
    )
    return m


@query(
    """WITH d AS (SELECT CASE WHEN event_id % 13 = 1 THEN 'nan'::DOUBLE ELSE value END AS x, ((event_id * 3) % 103) / 100.0::DOUBLE AS confidence, value - 2 AS intensity, CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 5 = 1 THEN 4 END AS n FROM events)
SELECT CASE WHEN isnan(x) THEN 'x is not finite' WHEN confidence > 1 THEN 'confidence is outside [0, 1]' WHEN intensity < 0 THEN 'intensity is negative' WHEN n = 3 THEN 'bbox has not 4 numbers' ELSE 'sound' END AS fault, count(*) AS n FROM d GROUP BY 1"""
)
def validate_detections(spark, sf):
    i, x = F.col("event_id"), F.col("value")
    box = F.when(i % 5 == 0, F.array(x, x, x)).when(i % 5 == 1, F.array(x, x, x, x))
    d = tables.read(spark, sf, "events").select(
        F.when(i % 13 == 1, F.lit(float("nan"))).otherwise(x).alias("x"), x.alias("y"), F.lit(0.0).alias("ts"), (((i * 3) % 103) / 100.0).alias("confidence"), (x - 2).alias("intensity"), F.lit(1.0).alias("size"), box.alias("bbox")
    )
    return _faults(d, V.detection_faults(2))


@query(
    """WITH t AS (SELECT event_id % 10 AS track_id, list_extract(['TENTATIVE', 'CONFIRMED', 'COASTING', 'DELETED', 'LOST'], CAST(event_id % 5 AS INTEGER) + 1) AS state, event_id % 9 - 1 AS hits FROM events)
SELECT CASE WHEN track_id <= 0 THEN 'track_id is not positive' WHEN state = 'LOST' THEN 'unknown state' WHEN hits < 0 THEN 'hits is negative' ELSE 'sound' END AS fault, count(*) AS n,
count(*) FILTER (WHERE state = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE state IN ('TENTATIVE', 'CONFIRMED')) AS active FROM t GROUP BY 1"""
)
def validate_tracks(spark, sf):
    i = F.col("event_id")
    states = F.array(*[F.lit(s) for s in ("TENTATIVE", "CONFIRMED", "COASTING", "DELETED", "LOST")])
    t = tables.read(spark, sf, "events").select(
        F.col("value").alias("x"), F.col("value").alias("y"), F.lit(0.0).alias("ts"), (i % 10).alias("track_id"), F.get(states, (i % 5).cast("int")).alias("state"), F.lit(1).alias("age"), (i % 9 - 1).alias("hits"), F.lit(0).alias("time_since_update")
    )
    t = t.withColumn("fault", F.coalesce(V.first_fault(V.track_faults(2)), F.lit("sound")))
    return t.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), *_how_many(confirmed=tracking.is_confirmed(), active=tracking.is_active()))


@query(
    f"""WITH {_EVID}, e AS (SELECT CASE WHEN ts % 7 = 1 THEN '  ' ELSE link_id END AS link_id, activity - 0.4 AS activity, health_score * 1.9 AS h FROM ev)
SELECT CASE WHEN trim(link_id) = '' THEN 'link_id is blank' WHEN activity < 0 THEN 'activity is negative' WHEN h > 1 THEN 'health_score is outside [0, 1]' ELSE 'sound' END AS fault, count(*) AS n FROM e GROUP BY 1"""
)
def validate_evidence(spark, sf):
    e = evidence(spark, sf)
    e = e.withColumn("link_id", F.when(F.col("ts") % 7 == 1, "  ").otherwise(F.col("link_id")))
    return _faults(e.withColumn("activity", F.col("activity") - 0.4).withColumn("health_score", F.col("health_score") * 1.9), V.evidence_faults())


@query(
    """WITH g AS (SELECT CASE WHEN s_suppkey % 7 = 1 THEN ' ' ELSE s_name END AS link_id, CASE WHEN s_suppkey % 5 = 2 THEN 'nan'::DOUBLE ELSE s_acctbal END AS x, s_acctbal AS f FROM supplier)
SELECT CASE WHEN trim(link_id) = '' THEN 'link_id is blank' WHEN isnan(x) THEN 'an end is not finite' WHEN f <= 0 THEN 'frequency is not positive' ELSE 'sound' END AS fault, count(*) AS n FROM g GROUP BY 1"""
)
def validate_geometry(spark, sf):
    k, x = F.col("s_suppkey"), F.col("s_acctbal")
    point = F.struct(F.when(k % 5 == 2, F.lit(float("nan"))).otherwise(x).alias("x"), x.alias("y"), x.alias("z"))
    g = tables.read(spark, sf, "supplier").select(F.when(k % 7 == 1, " ").otherwise(F.col("s_name")).alias("link_id"), point.alias("tx"), point.alias("rx"), x.alias("frequency_hz"))
    return _faults(g, V.geometry_faults())


@query(
    """WITH g AS (SELECT CASE WHEN c_custkey % 11 = 3 THEN 'inf'::DOUBLE ELSE c_acctbal END AS value, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 9000 END AS confidence FROM customer)
SELECT CASE WHEN NOT isfinite(value) THEN 'value is not finite' WHEN confidence < 0 OR confidence > 1 THEN 'confidence is outside [0, 1]' ELSE 'sound' END AS fault, count(*) AS n FROM g GROUP BY 1"""
)
def validate_fields(spark, sf):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    g = tables.read(spark, sf, "customer").select(F.when(k % 11 == 3, F.lit(float("inf"))).otherwise(x).alias("value"), F.when(k % 4 != 0, x / 9000).alias("confidence"))
    return _faults(g, V.field_faults())


@query(
    f"""WITH {FRAMES}, b AS (SELECT ts, CASE WHEN ts % 7 = 3 THEN list_prepend('inf'::DOUBLE, a[2:]) WHEN ts % 11 = 5 THEN a[2:] WHEN ts % 13 = 6 THEN [] ELSE a END AS a, len(a) AS n FROM f)
SELECT CASE WHEN len(a) = 0 THEN 'amplitude is empty' WHEN len(a) <> n THEN 'amplitude and phase differ in length' ELSE 'sound' END AS fault, count(*) AS n FROM b GROUP BY 1"""
)
def validate_legacy_frames(spark, sf):
    """Frames of the old form: shapes are checked, members of arrays are not."""
    t = F.col("ts")
    spoilt = F.when(t % 7 == 3, F.concat(F.array(F.lit(float("inf"))), F.slice("amplitude", 2, 100000))).when(t % 11 == 5, F.slice("amplitude", 2, 100000)).when(t % 13 == 6, F.slice("amplitude", 1, 0)).otherwise(F.col("amplitude"))
    return _faults(tables.to_legacy(tables.frames(spark, sf).withColumn("amplitude", spoilt)), V.legacy_frame_faults())


_SUM = "list_sum(list_transform({a}, lambda x: x))"


@query(
    f"""WITH {FRAMES}, x AS (SELECT 'default' AS link_id, CAST(NULL AS VARCHAR) AS source, ts, a FROM f UNION ALL SELECT 'synthetic', 'synthetic', ts, a FROM f UNION ALL SELECT link_id, CAST(NULL AS VARCHAR), ts, a FROM f)
SELECT link_id, source, count(*) AS n, {r(f'sum({_SUM.format(a="a")})')} AS total, {r('sum(ts)')} AS times FROM x GROUP BY link_id, source"""
)
def frame_adapters(spark, sf):
    """Frames to the old form and back, and from the synthetic form, with the ids and sources they are given."""
    f = tables.frames(spark, sf)
    old = tables.as_frame(tables.to_legacy(f))
    made = tables.as_frame(f.select(F.col("ts").alias("timestamp"), F.col("amplitude").alias("amplitudes"), F.col("phase").alias("phases")), source="synthetic")
    named = tables.as_frame(f.select("link_id", F.col("ts").alias("timestamp"), "amplitude", "phase"))
    every = old.unionByName(made).unionByName(named)
    total = F.aggregate("amplitude", F.lit(0.0), lambda a, x: a + x)
    return rounded(every.groupBy("link_id", F.try_element_at("meta", F.lit("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.sum("ts").alias("times")), "total", "times")


@query(f"WITH {FRAMES} SELECT link_id, ts, {r(_SUM.format(a='a'))} AS raw, {r('2 * ' + _SUM.format(a='a'))} AS changed, 'doubled' AS conditioning_method FROM f")
def frames_from_raw(spark, sf):
    """Conditioned frames keep the raw arrays beside the new ones."""
    f = tables.as_frame(tables.frames(spark, sf))
    c = tables.from_raw(f, F.transform("amplitude", lambda x: 2 * x), F.col("phase"), "doubled")
    total = lambda n: F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return rounded(c.select("link_id", "ts", total("amplitude_raw").alias("raw"), total("amplitude").alias("changed"), "conditioning_method"), "raw", "changed")


@query(f"WITH {FRAMES}, n AS (SELECT link_id, ts, row_number() OVER (PARTITION BY link_id ORDER BY ts) AS rn FROM f) SELECT link_id, CAST((rn - {W}) / {STRIDE} AS INTEGER) AS w_idx, ts AS last_ts, {W} AS n_frames FROM n WHERE rn >= {W} AND (rn - {W}) % {STRIDE} = 0")
def frames_grouped_by_window(spark, sf):
    w = preprocess.sliding_window(tables.frames(spark, sf), W, STRIDE)
    return w.select("link_id", "w_idx", F.element_at("frames", -1)["ts"].alias("last_ts"), F.size("frames").alias("n_frames"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 64 ELSE 1 END AS dim, event_id % 2 = 1 AS scalar, round(CASE WHEN event_id % 2 = 0 THEN value * 64 ELSE value END, 6) + 0.0 AS total FROM events")
def measurement_forms(spark, sf):
    """Scalars and vectors seen alike: dimension, kind and content."""
    e = tables.read(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    m = e.select("event_id", F.when(~even, F.col("value")).alias("value"), F.when(even, F.array_repeat("value", 64)).alias("vector"))
    total = F.aggregate(V.as_array(), F.lit(0.0), lambda a, x: a + x)
    return rounded(m.select("event_id", V.measured_dim().alias("dim"), V.is_scalar().alias("scalar"), total.alias("total")), "total")


@query(
    """SELECT event_id, round(value, 6) + 0.0 AS x, CASE WHEN event_id % 3 = 0 THEN 4 END AS box, round(value / 2, 6) + 0.0 AS vx, CAST(event_id % 4 AS INTEGER) AS steps, '{"id":' || event_id || ',"state":"CONFIRMED"}' AS short FROM events"""
)
def records_in_the_plane(spark, sf):
    """Detections and tracks of space laid flat, and their short form for documents."""
    i, x = F.col("event_id"), F.col("value")
    e = tables.read(spark, sf, "events")
    d = e.select("event_id", x.alias("x"), x.alias("y"), x.alias("z"), F.when(i % 3 == 0, F.array(*[x] * 6)).alias("bbox"))
    step = F.struct(F.lit(0.0).alias("t"), x.alias("x"), x.alias("y"), x.alias("z"))
    t = e.select("event_id", x.alias("x"), x.alias("y"), x.alias("z"), F.struct((x / 2).alias("vx"), x.alias("vy"), x.alias("vz")).alias("velocity"), F.array_repeat(step, (i % 4).cast("int")).alias("history"), i.alias("track_id"), F.lit("CONFIRMED").alias("state"))
    flat, track = tracking.detection_to_2d(d), tracking.track_to_2d(t)
    assert "z" not in flat.columns + track.columns and track.schema["velocity"].dataType.names == ["vx", "vy"]
    both = flat.select("event_id", "x", F.when(F.col("bbox").isNotNull(), F.size("bbox")).alias("box")).join(track.select("event_id", F.col("velocity.vx").alias("vx"), F.size("history").alias("steps"), F.to_json(F.struct(F.col("track_id").alias("id"), "state")).alias("short")), "event_id")
    return rounded(both, "x", "vx")


@query(f"WITH {FRAMES}, x AS (SELECT label AS k, CAST(vec_id AS DOUBLE) AS v FROM embeddings) SELECT k, v, {r('tanh(20 * v / 10000)')} AS activity, {r('0.5 * tanh(20 * v / 10000)')} AS weighted FROM x")
def activity_scaling(spark, sf):
    """Measured values to activities, and activity times confidence."""
    e = tables.read(spark, sf, "embeddings").select(F.col("label").alias("k"), F.col("vec_id").cast("double").alias("v"))
    s = e.withColumn("link_id", F.col("k").cast("string")).select("k", "v", F.col("v").alias("ts"), "link_id", (F.col("v") / 10000).alias("value"), F.lit(1.0).alias("health_score"), F.struct(F.lit(0.5).alias("confidence")).alias("quality"))
    a = sensing.evidence_from(s).withColumnRenamed("ts", "v")
    return rounded(a.select(F.col("link_id").cast("int").alias("k"), "v", "activity", (F.col("activity") * F.col("confidence")).alias("weighted")), "activity", "weighted")


@query(f"WITH {_KERNEL} SELECT link_id, {r('sum(k)')} AS total, count(*) AS cells, 1 AS computed FROM kern GROUP BY link_id")
def kernel_cache(spark, sf):
    """Kernels of links come from the cache once they were computed, whatever their geometry is then."""
    cache = fusion.KernelCache(tables.grid(spark), 0.25)
    links = tables.default_links(spark)
    cache.get(links)
    moved = links.withColumn("frequency_hz", F.lit(1.0))
    k = cache.get(moved)
    return rounded(k.groupBy("link_id").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("cells")).withColumn("computed", F.lit(cache.computed)), "total")


@query(f"WITH {_EVID}, g AS (SELECT ts, link_id, CASE WHEN health_score < 0.35 OR activity - 0.01 <= 0 THEN 0 ELSE (activity - 0.01) * health_score * confidence END AS s FROM ev) SELECT ts, 'geometry_fusion_ph2' AS source, 1 AS frame_count, CAST(count(*) FILTER (WHERE s > 0) AS INTEGER) AS n_active, coalesce(string_agg(link_id, ',' ORDER BY link_id) FILTER (WHERE s > 0), '') AS active_links FROM g GROUP BY ts")
def fusion_metadata(spark, sf):
    g = fusion.gate(tables.default_links(spark), evidence(spark, sf), fusion.ServerConfig())
    m = fusion.metadata(g)
    return m.select("ts", "source", "frame_count", F.size("link_ids").alias("n_active"), F.array_join("link_ids", ",").alias("active_links"))


@query("SELECT * FROM (VALUES ('three ticks', 3, 3, 3, 16), ('an object less', 2, 5, 2, 16), ('set back, another grid', 1, 1, 2, 8), ('no objects', 0, 2, 0, 8)) t(what, objects, steps, moved, cells)")
def update_loop(spark, sf):
    """The loop that moves the world: steps, objects put in and taken out, grids changed, the counter set back."""
    loop = UpdateLoop(tables.default_links(spark), tables.default_objects(spark), dt=0.05, grid=tables.voxel_grid(spark, (2.0, 1.0, 1.0), (0.0, 0.0, 0.0), 0.5))
    out = []

    def note(what: str, moved: int, cells: int) -> None:
        out.append((what, loop.objects.count(), loop.step_count, moved, cells))

    made = loop.run(3)
    note("three ticks", made.objects.select("object_id").distinct().count(), made.field.count())
    loop.remove_object("fan")
    made = loop.run(2)
    note("an object less", made.objects.select("object_id").distinct().count(), made.field.count())
    loop.reset_step_count()
    loop.set_voxel_grid(tables.voxel_grid(spark, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), 0.5))
    made = loop.step()
    n = made.objects.count()
    loop.remove_object("walker")
    note("set back, another grid", n, made.field.count())
    loop.clear_objects()
    made = loop.step()
    note("no objects", made.objects.count(), made.field.count())
    return spark.createDataFrame(out, "what string, objects int, steps int, moved int, cells int")


@query("SELECT 'walker' AS object_id, 'moving' AS kind, true AS listed UNION ALL SELECT 'person', 'static', true UNION ALL SELECT 'lamp', 'oscillating', true")
def world_objects(spark, sf):
    """Objects put in, taken out and listed; what is no disturbance is refused."""
    o = world.remove_object(tables.default_objects(spark), "fan")
    o = world.add_objects(o, o.where("object_id = 'person'").withColumns({"object_id": F.lit("lamp"), "kind": F.lit("oscillating")}))
    return o.select("object_id", "kind", F.lit(True).alias("listed"))


@query("SELECT link_id, 'NOMINAL' AS status, true AS as_json FROM (SELECT CAST(label AS VARCHAR) AS link_id FROM embeddings GROUP BY label)")
def record_documents(spark, sf):
    """The short forms of detections, tracks, link health and entities as JSON."""
    f = tables.frames(spark, sf).select("link_id").distinct()
    h = f.select("link_id", F.lit("NOMINAL").alias("status"), *[F.lit(1.0).alias(n) for n in ("snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score")])
    doc = F.from_json(R.document("link_health"), "struct<link_id:string,status:string,health_score:double>")
    return h.select("link_id", doc["status"].alias("status"), ((doc["link_id"] == F.col("link_id")) & (doc["health_score"] == 1.0)).alias("as_json"))


@query(ORACLE_SQL["validate_measurements"])
def quarantined_measurements(spark, sf):
    """Faults counted while sound and faulty rows are parted, and the parts counted again."""
    sound, faulty, counts = split_once(_measurements(spark, sf), V.measurement_faults(), Rounds(spark))
    parts = faulty.select("fault").unionByName(sound.select(F.lit("sound").alias("fault"))).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    seen = spark.createDataFrame([(f, n) for f, n in counts.items() if n], "fault string, observed bigint")
    both = parts.join(seen, "fault", "full")
    return both.select("fault", F.when(F.col("n") == F.col("observed"), F.col("n")).alias("n"))


_PROPS = "CASE WHEN event_id % 17 = 0 THEN substr(props, 1, len(props) - 1) WHEN event_id % 5 = 0 THEN '{\"pos\": {\"x\": ' || CAST(event_id % 100 AS VARCHAR) || '.5}, \"tags\": [\"a\", \"b' || CAST(event_id % 3 AS VARCHAR) || '\"], \"k\": \"none\"}' WHEN event_id % 23 = 0 THEN NULL ELSE props END"


@query(
    f"""WITH p AS (SELECT event_id, event_type, {_PROPS} AS p FROM events), v AS (SELECT event_id, event_type, CASE WHEN json_valid(p) THEN p END AS v FROM p)
SELECT event_id, v IS NOT NULL AS parsed, CASE WHEN json_type(v, '$.k') <> 'VARCHAR' THEN CAST(v->>'$.k' AS BIGINT) END AS k, CAST(v->>'$.pos.x' AS DOUBLE) AS x, v->>'$.tags[1]' AS tag,
CAST(coalesce(json_array_length(v, '$.tags'), 0) AS INTEGER) AS n_tags FROM v"""
)
def event_properties(spark, sf):
    """The JSON properties of all events, some malformed, nested or missing, as VARIANT."""
    i, p = F.col("event_id"), F.col("props")
    nested = F.concat(F.lit('{"pos": {"x": '), (i % 100).cast("string"), F.lit('.5}, "tags": ["a", "b'), (i % 3).cast("string"), F.lit('"], "k": "none"}'))
    text = F.when(i % 17 == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(i % 5 == 0, nested).when(i % 23 != 0, p)
    rows = tables.read(spark, sf, "events").select("event_id", variant.parsed(text).alias("v"))
    v = F.col("v")
    tags = variant.field(v, "$.tags", "array<string>")
    return rows.select(
        "event_id", v.isNotNull().alias("parsed"), variant.field(v, "$.k", "bigint").alias("k"), variant.field(v, "$.pos.x", "double").alias("x"), variant.field(v, "$.tags[1]", "string").alias("tag"),
        F.coalesce(F.size(tags), F.lit(0)).alias("n_tags"),
    )
