"""Queries over the room: validation, grids, world, fusion, regions, tracking, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.config import ServerConfig
from fieldlark.functions import predicates as V
from fieldlark.operators import cluster, fusion, grid, message, synthetic, tracking, world
from fieldlark.operators.scan import scan_linear
from fieldlark.plans.frame_queries import FRAMES, SENSED, half_away, r, rounded
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


GRID = "g AS MATERIALIZED (SELECT CAST(floor((c_acctbal + 1000.0::DOUBLE) / 275.0::DOUBLE) AS INTEGER) AS i, c_nationkey AS j, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY ALL)"
VOX = "v AS MATERIALIZED (SELECT CAST(trunc(l_quantity) AS INTEGER) AS i, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS j, CAST(round_even(l_tax * 100, 0) AS INTEGER) AS k, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"
SHAPE = (51, 11, 9)
DENSE = f"{VOX}, d AS MATERIALIZED (SELECT a.i, b.j, c.k, coalesce(v.value, 0) AS value FROM (SELECT CAST(unnest(range({SHAPE[0]})) AS INTEGER) AS i) a CROSS JOIN (SELECT CAST(unnest(range({SHAPE[1]})) AS INTEGER) AS j) b CROSS JOIN (SELECT CAST(unnest(range({SHAPE[2]})) AS INTEGER) AS k) c LEFT JOIN v ON v.i = a.i AND v.j = b.j AND v.k = c.k)"


def _dense(spark, sf) -> DataFrame:
    return grid.densify(tables.voxels(spark, sf), SHAPE)


# validation


@query(
    f"""WITH {FRAMES}, b AS (SELECT link_id, ts, CASE WHEN ts % 7 = 3 THEN list_prepend('inf'::DOUBLE, a[2:]) WHEN ts % 11 = 5 THEN a[2:] ELSE a END AS a, len(a) AS n, CASE WHEN ts % 13 = 1 THEN '' ELSE link_id END AS id FROM f),
c AS (SELECT CASE WHEN id = '' THEN 'link_id is empty' WHEN len(a) <> n THEN 'amplitude and phase differ in length' WHEN len(list_filter(a, lambda x: NOT isfinite(x))) > 0 THEN 'amplitude is not finite' ELSE 'sound' END AS fault FROM b)
SELECT fault, count(*) AS n FROM c GROUP BY fault"""
)
def validate_frames(spark, sf):
    f = tables.frames(spark, sf)
    spoilt = F.when(F.col("ts") % 7 == 3, F.concat(F.array(F.lit(float("inf"))), F.slice("amplitude", 2, 100000))).when(F.col("ts") % 11 == 5, F.slice("amplitude", 2, 100000)).otherwise(F.col("amplitude"))
    f = f.withColumn("amplitude", spoilt).withColumn("link_id", F.when(F.col("ts") % 13 == 1, F.lit("")).otherwise(F.col("link_id")))
    good, bad = V.quarantine(f, V.frame_faults())
    return good.select(F.lit("sound").alias("fault")).unionByName(bad.select("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE isfinite(value)) AS finite, count(*) FILTER (WHERE isfinite(value) AND value > 0) AS positive, count(*) FILTER (WHERE value BETWEEN 10 AND 50) AS in_range, count(*) FILTER (WHERE value > 10 AND value < 50) AS inside FROM events")
def validate_scalars(spark, sf):
    e = tables.series(spark, sf)
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    x = F.col("value")
    return e.agg(n(V.finite(x), "finite"), n(V.positive(x), "positive"), n(V.in_range(x, 10, 50), "in_range"), n(V.in_range(x, 10, 50, False), "inside"))


@query(
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS link_id, event_id, (event_id * 7919) % 101 AS ts FROM events), o AS (SELECT link_id, ts, row_number() OVER w - 1 AS idx, ts <= lag(ts) OVER w AS bad FROM t WINDOW w AS (PARTITION BY link_id ORDER BY event_id))
SELECT link_id, CAST(min(idx) AS INTEGER) AS first_bad, arg_min(ts, idx) AS at FROM o WHERE bad GROUP BY link_id"""
)
def monotonic_timestamps(spark, sf):
    e = tables.series(spark, sf).withColumn("t", (F.col("seq") * 7919) % 101)
    return V.out_of_order(e, "link_id", "t", "seq")


def _quality(spark, sf) -> DataFrame:
    """Events as measurements with a quality made from their ids."""
    e = tables.series(spark, sf)
    part = lambda m: ((F.col("seq") * m) % 101) / 100.0
    q = F.struct(F.col("value").alias("snr"), part(3).alias("confidence"), part(7).alias("completeness"), part(11).alias("stability"), part(13).alias("outlier_score"))
    return e.select("seq", q.alias("quality"))


@query(
    f"""WITH q AS (SELECT event_id AS seq, ((event_id * 3) % 101) / 100.0::DOUBLE AS c, ((event_id * 7) % 101) / 100.0::DOUBLE AS p, ((event_id * 11) % 101) / 100.0::DOUBLE AS s, ((event_id * 13) % 101) / 100.0::DOUBLE AS o FROM events)
SELECT seq, {r('c * p * s * (1 - o)')} AS combined, c >= 0.5 AND o < 0.5 AS reliable FROM q"""
)
def measurement_quality(spark, sf):
    return rounded(_quality(spark, sf).select("seq", V.combined_quality().alias("combined"), V.is_reliable().alias("reliable")), "combined")


# fields and voxels


@query(f"WITH {GRID}, d AS (SELECT coalesce(g.value, 0) AS value FROM (SELECT unnest(range(40)) AS i) a CROSS JOIN (SELECT unnest(range(25)) AS j) b LEFT JOIN g ON g.i = a.i AND g.j = b.j) SELECT max(value) AS max_value, {r('avg(value)')} AS mean_value, sum(value) AS total_value FROM d")
def field_statistics(spark, sf):
    return rounded(grid.stats(grid.densify(tables.grid2d(spark, sf), (40, 25))), "mean_value")


@query(
    f"""WITH {GRID}, p AS (SELECT event_id, -1 + value / 10 AS x, value / 20 AS y FROM events), c AS (SELECT event_id, CAST(trunc(x / 0.5::DOUBLE) AS INTEGER) AS i, CAST(trunc(y / 0.5::DOUBLE) AS INTEGER) AS j FROM p),
k AS (SELECT event_id, CASE WHEN i >= 0 AND i < 40 THEN i END AS i, CASE WHEN j >= 0 AND j < 25 THEN j END AS j FROM c)
SELECT event_id, k.i, k.j, g.value, {r('(k.i + 0.5::DOUBLE) * 0.5::DOUBLE')} AS cx FROM k LEFT JOIN g ON g.i = k.i AND g.j = k.j"""
)
def value_at_points(spark, sf):
    e = tables.read(spark, sf, "events").select("event_id", (-1 + F.col("value") / 10).alias("x"), (F.col("value") / 20).alias("y"))
    out = grid.value_at(e, tables.grid2d(spark, sf), (0.0, 0.0), 0.5, (40, 25))
    return rounded(out.select("event_id", "i", "j", "value", grid.cell_center(F.col("i"), 0.0, 0.5).alias("cx")), "cx")


def _projection(axis, method):
    def run(spark, sf):
        return rounded(grid.project(_dense(spark, sf), axis, method), "value")

    return run


for _axis, _name in (("z", "floor"), ("y", "xz"), ("x", "yz")):
    _a, _b = grid.KEEP[_axis]
    for _method in ("sum", "max", "mean"):
        QUERIES[f"projection_{_name}_{_method}"] = _projection(_axis, _method)
        ORACLE_SQL[f"projection_{_name}_{_method}"] = f"WITH {DENSE} SELECT {_a}, {_b}, {r({'sum': 'sum', 'max': 'max', 'mean': 'avg'}[_method] + '(value)')} AS value FROM d GROUP BY {_a}, {_b}"


@query(f"WITH {DENSE} SELECT CASE WHEN grouping(k) = 1 THEN 'xy' WHEN grouping(j) = 1 THEN 'xz' ELSE 'yz' END AS plane, CASE WHEN grouping(i) = 1 THEN j ELSE i END AS a, CASE WHEN grouping(k) = 1 THEN j ELSE k END AS b, max(value) AS value FROM d GROUP BY GROUPING SETS ((i, j), (i, k), (j, k))")
def all_projections(spark, sf):
    return grid.all_projections(_dense(spark, sf))


@query(f"WITH {DENSE}, t AS (SELECT i, j, k, CASE WHEN value > 12 THEN value ELSE 0 END AS value FROM d) SELECT CASE WHEN grouping(k) = 1 THEN 'xy' WHEN grouping(j) = 1 THEN 'xz' ELSE 'yz' END AS plane, CASE WHEN grouping(i) = 1 THEN j ELSE i END AS a, CASE WHEN grouping(k) = 1 THEN j ELSE k END AS b, max(value) AS value FROM t GROUP BY GROUPING SETS ((i, j), (i, k), (j, k))")
def orthographic_projections(spark, sf):
    return grid.orthographic(_dense(spark, sf), 12.0)


@query(f"WITH {DENSE} SELECT i, j, max(value) AS value, {r('arg_max(((i * 7 + j * 3 + k * 5) % 11) / 10.0::DOUBLE, value - k * 1e-9)')} AS confidence FROM d GROUP BY i, j")
def project_floor_with_confidence(spark, sf):
    c = ((F.col("i") * 7 + F.col("j") * 3 + F.col("k") * 5) % 11) / 10.0
    return rounded(grid.project_floor(_dense(spark, sf).withColumn("confidence", c)), "confidence")


@query(f"WITH {VOX} SELECT 'z' AS axis, i AS a, j AS b, value FROM v WHERE k = 4 UNION ALL SELECT 'x', j, k, value FROM v WHERE i = 10 UNION ALL SELECT 'y', i, k, value FROM v WHERE j = 5")
def slices(spark, sf):
    v = tables.voxels(spark, sf)
    out = None
    for axis, index, n in (("z", 4, SHAPE[2]), ("x", 10, SHAPE[0]), ("y", 5, SHAPE[1])):
        p = grid.slice_at(v, axis, index, n)
        a, b = grid.KEEP[axis]
        p = p.select(F.lit(axis).alias("axis"), F.col(a).alias("a"), F.col(b).alias("b"), "value")
        out = p if out is None else out.unionByName(p)
    return out


@query(f"WITH {VOX} SELECT k, i, j, value FROM v WHERE k IN (0, 2, 5, 8)")
def sampled_slices(spark, sf):
    return grid.sampled_slices(tables.voxels(spark, sf), SHAPE[2], 4)


@query(
    f"""WITH {VOX}, a AS MATERIALIZED (SELECT i, j, k FROM v WHERE value > 8), s AS (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(x, y, z)),
n AS (SELECT a.i, a.j, a.k, count(b.i) AS n FROM a CROSS JOIN s LEFT JOIN a b ON b.i = a.i + x AND b.j = a.j + y AND b.k = a.k + z GROUP BY ALL) SELECT i, j, k FROM n WHERE n < 6"""
)
def boundary_voxels(spark, sf):
    return grid.boundary(tables.voxels(spark, sf), 8.0)


@query(f"WITH {VOX} SELECT i, j, k, value FROM v WHERE value > 10")
def threshold_voxels(spark, sf):
    return grid.above(tables.voxels(spark, sf), 10.0)


@query()
def subsample_voxels(spark, sf):
    return grid.subsample(tables.voxels(spark, sf), 1000)


@query(f"WITH {VOX} SELECT least(count(*), 1000) AS n, true AS distinct_voxels, true AS from_the_table FROM v")
def subsample_is_sound(spark, sf):
    """A subsample has the size asked for, no voxel twice and no voxel of its own."""
    v = tables.voxels(spark, sf)
    s = grid.subsample(v, 1000)
    n = F.count(F.lit(1))
    met = s.join(v.select("i", "j", "k", F.col("value").alias("v")), ["i", "j", "k"], "left")
    return met.agg(n.alias("n"), (F.count_distinct("i", "j", "k") == n).alias("distinct_voxels"), F.bool_and(F.col("value").eqNullSafe(F.col("v"))).alias("from_the_table"))


@query(f"WITH {VOX}, s AS (SELECT i, j, k, value / 2 AS s FROM v WHERE k < 3) SELECT i, j, k, {r('v.value * 0.9::DOUBLE + 0.5::DOUBLE * coalesce(s, 0)')} AS value FROM v LEFT JOIN s USING (i, j, k)")
def decay_and_accumulate(spark, sf):
    v = tables.voxels(spark, sf)
    sample = v.where("k < 3").withColumn("value", F.col("value") / 2)
    return rounded(grid.accumulate(grid.decay(v, 0.9), sample, 0.5), "value")


@query(f"WITH {VOX} SELECT i, j, k, CASE WHEN k < 2 AND value > 3 THEN value * 10 ELSE value END AS value FROM v UNION ALL SELECT 99, 0, 0, 7.0::DOUBLE")
def set_values(spark, sf):
    """Cells replaced, and one put in that the sparse volume did not have."""
    v = tables.voxels(spark, sf)
    new = v.where("k < 2 and value > 3").withColumn("value", F.col("value") * 10)
    return grid.set_values(v, new.unionByName(spark.createDataFrame([(99, 0, 0, 7.0)], "i int, j int, k int, value double")))


@query(f"WITH {VOX} SELECT count(*) AS n, 0.0::DOUBLE AS largest FROM v")
def clear_voxels(spark, sf):
    c = grid.clear(tables.voxels(spark, sf))
    return c.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("largest"))


@query(f"WITH {VOX}, {GRID} SELECT min(value) AS vmin, max(value) AS vmax FROM (SELECT value FROM v UNION ALL SELECT value FROM g)")
def shared_colour_limits(spark, sf):
    return grid.limits(tables.voxels(spark, sf), tables.grid2d(spark, sf))


# world and synthetic channel

_OBJ = "o(object_id, kind, x, y, z, vx, vy, radius, intensity, amplitude, frequency, x_min, x_max, y_min, y_max) AS (SELECT a, b, CAST(c AS DOUBLE), CAST(d AS DOUBLE), CAST(e AS DOUBLE), CAST(f AS DOUBLE), CAST(g AS DOUBLE), CAST(h AS DOUBLE), CAST(i AS DOUBLE), CAST(j AS DOUBLE), CAST(k AS DOUBLE), CAST(l AS DOUBLE), CAST(m AS DOUBLE), CAST(n AS DOUBLE), CAST(p AS DOUBLE) FROM (VALUES ('walker','moving',0,-3,1.5,0.3,1.4,1.1,1.5,0,0,-4,4,-3.5,3.5),('person','static',1,1,1,0,0,0.8,1,0,0,-4,4,-4,4),('fan','oscillating',-2,2,1.2,0,0,0.7,0.8,0.4,0.5,-4,4,-4,4)) t(a,b,c,d,e,f,g,h,i,j,k,l,m,n,p))"
TICKS, DT = 120, 0.05
_MOVE = f"""{_OBJ}, m AS (SELECT object_id, 0 AS tick, x, y, vx, vy FROM o UNION ALL
SELECT m.object_id, tick + 1, CASE WHEN kind = 'moving' THEN least(greatest(m.x + m.vx * {DT}::DOUBLE, x_min), x_max) ELSE m.x END, CASE WHEN kind = 'moving' THEN least(greatest(m.y + m.vy * {DT}::DOUBLE, y_min), y_max) ELSE m.y END,
CASE WHEN m.x + m.vx * {DT}::DOUBLE < x_min OR m.x + m.vx * {DT}::DOUBLE > x_max THEN -m.vx ELSE m.vx END, CASE WHEN m.y + m.vy * {DT}::DOUBLE < y_min OR m.y + m.vy * {DT}::DOUBLE > y_max THEN -m.vy ELSE m.vy END
FROM m JOIN o ON m.object_id = o.object_id WHERE tick < {TICKS}),
w AS MATERIALIZED (SELECT m.object_id, tick, tick * {DT}::DOUBLE AS t, m.x, m.y, o.z, o.radius, CASE WHEN kind = 'oscillating' THEN greatest(0, intensity + amplitude * sin(2 * pi() * frequency * tick * {DT}::DOUBLE)) ELSE intensity END AS intensity FROM m JOIN o ON m.object_id = o.object_id WHERE tick >= 1)"""


def _objects(spark):
    return world.at_ticks(tables.default_objects(spark), TICKS, DT)


@query(f"WITH RECURSIVE {_MOVE} SELECT object_id, CAST(tick AS INTEGER) AS tick, {r('t')} AS t, {r('x')} AS x, {r('y')} AS y, {r('intensity')} AS intensity FROM w")
def world_motion(spark, sf):
    return rounded(_objects(spark).select("object_id", "tick", "t", "x", "y", "intensity"), "t", "x", "y", "intensity")


_GAUSS = "sum(CASE WHEN {d} <= 9 * w.radius * w.radius THEN w.intensity * exp(-({d}) / (2 * w.radius * w.radius)) ELSE 0 END)"


def _d2(p: str) -> str:
    return f"(({p}.x - w.x) * ({p}.x - w.x) + ({p}.y - w.y) * ({p}.y - w.y) + ({p}.z - w.z) * ({p}.z - w.z))"


_CELLS = "p AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, -2 + (i + 0.5) * 0.5::DOUBLE AS x, -2 + (j + 0.5) * 0.5::DOUBLE AS y, (k + 0.5) * 0.5::DOUBLE AS z FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS j) b, (SELECT unnest(range(4)) AS k) c)"


@query(f"WITH RECURSIVE {_MOVE}, {_CELLS} SELECT i, j, k, {r(_GAUSS.format(d=_d2('p')))} AS value FROM p, (SELECT * FROM w WHERE tick = 100) w GROUP BY i, j, k")
def sample_world(spark, sf):
    points = tables.voxel_grid(spark, (4.0, 4.0, 2.0), (-2.0, -2.0, 0.0), 0.5)
    return rounded(world.field_at(points, _objects(spark).where("tick = 100").drop("tick"), ["i", "j", "k"]), "value")


@query(f"WITH RECURSIVE {_MOVE}, {_CELLS} SELECT i, j, k, {r(_GAUSS.format(d=_d2('p')))} AS value FROM p, (SELECT * FROM w WHERE tick = 100) w GROUP BY i, j, k")
def sample_world_by_bins(spark, sf):
    """The way for many objects: points and objects meet by bin."""
    points = tables.voxel_grid(spark, (4.0, 4.0, 2.0), (-2.0, -2.0, 0.0), 0.5)
    return rounded(world.field_at(points, _objects(spark).where("tick = 100").drop("tick"), ["i", "j", "k"], few=False), "value")


_LINKS = "links AS (SELECT a AS link_id, CAST(b AS DOUBLE) AS tx, CAST(c AS DOUBLE) AS ty, CAST(d AS DOUBLE) AS rx, CAST(e AS DOUBLE) AS ry FROM (VALUES ('link_0', -4.5, 0, 4.5, 0), ('link_1', 0, -4.5, 0, 4.5), ('link_2', -4.5, -4.5, 4.5, 4.5)) t(a, b, c, d, e))"
_PATH = f"""{_MOVE}, {_LINKS}, p AS (SELECT link_id, s, tx + (0.1 + s * (0.8 / 9)::DOUBLE) * (rx - tx) AS x, ty + (0.1 + s * (0.8 / 9)::DOUBLE) * (ry - ty) AS y, 1.5::DOUBLE AS z FROM links, (SELECT unnest(range(10)) AS s) t),
q AS (SELECT link_id, tick, s, {_GAUSS.format(d=_d2('p'))} AS v FROM p, w GROUP BY link_id, tick, s), dist AS MATERIALIZED (SELECT link_id, tick, avg(v) AS disturbance FROM q GROUP BY link_id, tick)"""


@query(f"WITH RECURSIVE {_PATH} SELECT link_id, CAST(tick AS INTEGER) AS tick, {r('disturbance')} AS disturbance FROM dist")
def path_disturbance(spark, sf):
    return rounded(world.path_disturbance(tables.default_links(spark), _objects(spark)), "disturbance")


_TH = "(2 * pi() * f / 5.8e9)"
_SHAPE = f"least(greatest((1 + 0.42 * s * cos(2.3 * {_TH} - 0.35 * t)) * (1 + 0.24 * s * sin(4.1 * {_TH} + 0.22 * t)), 0.35), 1.85)"
_BEND = f"(1.15 * s * sin(1.7 * {_TH} + 0.40 * t) + 0.60 * s * cos(3.6 * {_TH} - 0.28 * t))"


@query(
    f"""WITH RECURSIVE {_PATH}, c AS (SELECT d.link_id, tick * {DT}::DOUBLE AS t, k, 5.78e9 + k * (4e7 / 63)::DOUBLE AS f, disturbance AS dd, tanh(disturbance) AS s, sqrt((rx - tx) * (rx - tx) + (ry - ty) * (ry - ty)) AS dist
FROM dist d JOIN links ON d.link_id = links.link_id, (SELECT unnest(range(64)) AS k) ks)
SELECT link_id, {r('t')} AS ts, CAST(k AS INTEGER) AS k, round(least(1, 299792458.0 / f / (4 * pi() * dist)) * exp(-0.5 * abs(dd)) * {_SHAPE}, 9) + 0.0 AS amp, {r(f'2 * pi() * dist / (299792458.0 / f) + 2 * pi() * 0.1 * s / (299792458.0 / f) + {_BEND}')} AS phase FROM c"""
)
def synthetic_frames(spark, sf):
    """Noise-free frames of three links over a moving scene."""
    links = tables.default_links(spark)
    out = synthetic.generate(links, world.path_disturbance(links, _objects(spark)), DT)
    return out.select("link_id", F.round("ts", 6).alias("ts"), "k", F.round("amp", 9).alias("amp"), F.round("phase", 6).alias("phase"))


@query()
def noisy_frames(spark, sf):
    links = tables.default_links(spark)
    c = ServerConfig()
    return rounded(synthetic.generate(links, world.path_disturbance(links, _objects(spark)), DT, sigma_amp=c.amplitude_noise, sigma_phase=c.phase_noise, seed=42), "amp", "phase")


@query("SELECT 'link_' || CAST(n AS VARCHAR) AS link_id, true AS spread_of_phase, true AS mean_of_phase, true AS amplitudes_not_negative FROM (SELECT unnest(range(3)) AS n)")
def noise_has_its_law(spark, sf):
    """Noisy phases stray from clean ones by the deviation asked for, without a bias."""
    links = tables.default_links(spark)
    make = lambda **kw: synthetic.generate(links, world.path_disturbance(links, _objects(spark)), DT, **kw)
    clean = make().select("link_id", "ts", "k", F.col("phase").alias("p"))
    c = ServerConfig()
    off = make(sigma_amp=c.amplitude_noise, sigma_phase=c.phase_noise, seed=42).join(clean, ["link_id", "ts", "k"]).withColumn("d", F.col("phase") - F.col("p"))
    sigma = F.lit(c.phase_noise)
    return off.groupBy("link_id").agg((F.abs(F.stddev_samp("d") / sigma - 1) < 0.05).alias("spread_of_phase"), (F.abs(F.avg("d")) < 0.05 * sigma).alias("mean_of_phase"), F.bool_and(F.col("amp") >= 0).alias("amplitudes_not_negative"))


# fusion

_FLOOR = "cells AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, -5 + (i + 0.5) * 0.25::DOUBLE AS x, -5 + (j + 0.5) * 0.25::DOUBLE AS y FROM (SELECT unnest(range(40)) AS i) a, (SELECT unnest(range(40)) AS j) b)"
_KERNEL = f"""{_LINKS}, {_FLOOR}, k0 AS (SELECT link_id, i, j, x, y, tx, ty, rx, ry, sqrt((rx - tx) * (rx - tx) + (ry - ty) * (ry - ty)) AS len FROM cells, links),
k1 AS (SELECT *, ((x - tx) * (rx - tx) + (y - ty) * (ry - ty)) / len AS pr FROM k0),
k2 AS (SELECT *, tx + least(greatest(pr, 0), len) * (rx - tx) / len AS px, ty + least(greatest(pr, 0), len) * (ry - ty) / len AS py, CASE WHEN pr < 0 THEN -pr WHEN pr > len THEN pr - len ELSE 0 END AS o,
greatest(0, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) + sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) - len) AS ex, greatest(0.1875, 0.05 * len) AS sp, greatest(0.25, 0.08 * len) AS so FROM k1),
k3 AS (SELECT link_id, i, j, exp(-0.5 * ((x - px) * (x - px) + (y - py) * (y - py)) / (sp * sp)) * exp(-0.5 * power(o / so, 2)) * exp(-0.5 * power(ex / sp, 2)) AS k FROM k2),
kern AS MATERIALIZED (SELECT link_id, i, j, k / max(k) OVER (PARTITION BY link_id) AS k FROM k3)"""
_EVID = "ev AS MATERIALIZED (SELECT CAST(event_id // 500 AS DOUBLE) AS ts, 'link_' || CAST(user_id % 3 AS VARCHAR) AS link_id, tanh(avg(value) / 40) AS activity, count(*) / (count(*) + 200.0::DOUBLE) AS health_score, least(1.0, stddev_pop(value) / 40) AS confidence FROM events GROUP BY ALL)"


def evidence(spark, sf) -> DataFrame:
    """All events as evidence of three links, a tick every 500 events."""
    e = tables.read(spark, sf, "events")
    g = e.groupBy(F.expr("cast(event_id div 500 as double)").alias("ts"), F.concat(F.lit("link_"), (F.col("user_id") % 3).cast("string")).alias("link_id"))
    n = F.count(F.lit(1))
    return g.agg(F.tanh(F.avg("value") / 40).alias("activity"), (n / (n + 200.0)).alias("health_score"), F.least(F.lit(1.0), F.stddev_pop("value") / 40).alias("confidence"))


@query(f"WITH {_KERNEL} SELECT link_id, i, j, {r('k')} AS k FROM kern")
def fusion_kernels(spark, sf):
    return rounded(fusion.kernels(tables.default_links(spark), tables.grid(spark), 0.25), "k")


_GATED = f"{_EVID}, ga AS MATERIALIZED (SELECT ts, link_id, health_score AS h, confidence AS c, CASE WHEN health_score < 0.35 OR activity - 0.01 <= 0 THEN 0 ELSE (activity - 0.01) * health_score * confidence END AS s FROM ev)"


@query(f"WITH {_GATED} SELECT ts, link_id, {r('s')} AS strength FROM ga")
def gate_evidence(spark, sf):
    return rounded(fusion.gate(tables.default_links(spark), evidence(spark, sf), ServerConfig()).select("ts", "link_id", "strength"), "strength")


_FUSED = f"""{_KERNEL}, {_GATED}, per AS (SELECT ts, count(*) AS n, sum(s) AS tot, avg(s) AS mean FROM ga WHERE s > 0 GROUP BY ts), live AS (SELECT ga.*, per.n, per.mean, s / greatest(tot, 1e-9) AS w FROM ga JOIN per ON ga.ts = per.ts WHERE s > 0),
ref AS (SELECT i, j, greatest(sum(k), 1e-9) AS ref FROM kern GROUP BY i, j),
m AS (SELECT ts, i, j, sum(w * k) AS lin, exp(sum(w * ln(least(greatest(k, 1e-9), 1)))) AS geo, sum(w * k * k) AS sq, sum(k * h) AS kh, sum(k * h * c) AS khc, any_value(n) AS n, any_value(mean) AS mean FROM live JOIN kern ON live.link_id = kern.link_id GROUP BY ts, i, j),
sh AS (SELECT *, 0.25 * lin + 0.75 * geo AS shape FROM m), raw AS (SELECT *, CASE WHEN n >= 2 THEN power(least(greatest(shape, 0), 1), 1 + 0.35 * (n - 1)) ELSE shape END * mean AS raw FROM sh),
inst AS (SELECT ts, raw.i, raw.j, least(greatest(raw / greatest(1, max(raw) OVER (PARTITION BY ts)), 0), 1) AS value,
least(greatest(least(greatest(kh / ref, 0), 1) * khc / greatest(kh, 1e-9) * (1 - 0.5 * CASE WHEN n >= 2 THEN least(greatest(sqrt(greatest(sq - lin * lin, 0)) / greatest(lin, 1e-9), 0), 1) ELSE 0 END), 0), 1) AS confidence FROM raw JOIN ref ON raw.i = ref.i AND raw.j = ref.j),
fl AS MATERIALIZED (SELECT t.ts, cells.i, cells.j, coalesce(value, 0) AS value, coalesce(confidence, 0) AS confidence FROM (SELECT DISTINCT ts FROM ev) t CROSS JOIN cells LEFT JOIN inst ON inst.ts = t.ts AND inst.i = cells.i AND inst.j = cells.j)"""


@query(f"WITH {_FUSED} SELECT ts, i, j, {r('value')} AS value, round(confidence, 5) + 0.0 AS confidence FROM fl")
def fuse_instant(spark, sf):
    out = fusion.fuse(tables.default_links(spark), tables.grid(spark), evidence(spark, sf))
    return out.select("ts", "i", "j", F.round("value", 6).alias("value"), F.round("confidence", 5).alias("confidence"))


_HOLD = """nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY ts) AS rn FROM fl),
st AS (SELECT i, j, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS ts, CAST(0 AS DOUBLE) AS f, 0 AS cnt, false AS act, CAST(0 AS DOUBLE) AS confidence FROM cells UNION ALL
SELECT i, j, rn, ts, f, CASE WHEN f >= 0.12 THEN cnt + 1 ELSE 0 END, CASE WHEN f >= 0.12 THEN cnt + 1 ELSE 0 END >= 3 OR (act AND f >= 0.08), confidence
FROM (SELECT nn.i, nn.j, nn.rn, nn.ts, CAST(0.9 AS DOUBLE) * st.f + (1 - CAST(0.9 AS DOUBLE)) * nn.value AS f, st.cnt, st.act, nn.confidence FROM st JOIN nn ON nn.i = st.i AND nn.j = st.j AND nn.rn = st.rn + 1))"""


@query(f"WITH RECURSIVE {_FUSED}, {_HOLD} SELECT ts, i, j, {r('CASE WHEN act THEN f ELSE 0 END')} AS value, act AS active FROM st WHERE rn > 0")
def fuse_with_persistence(spark, sf):
    out = fusion.persist(fusion.fuse(tables.default_links(spark), tables.grid(spark), evidence(spark, sf)))
    return rounded(out.select("ts", "i", "j", "value", "active"), "value")


@query(f"WITH RECURSIVE {_FUSED}, {_HOLD} SELECT ts, i, j, {r('CASE WHEN act THEN f ELSE 0 END')} AS value, act AS active FROM st WHERE rn > 0")
def fuse_with_persistence_streamed(spark, sf):
    """The same evidence as a stream into the keyed state of the room, in four arrivals."""
    from fieldlark.streaming import room

    e = evidence(spark, sf).withColumn("room", F.lit("room"))
    ticks = room.replayed(e, lambda arriving: room.room_stream(arriving, tables.default_links(spark)))
    cells = F.posexplode(F.arrays_zip(F.col("data").alias("value"), F.col("active").alias("active")))
    out = ticks.select("ts", cells.alias("cell", "v")).select("ts", F.floor(F.col("cell") / 40).cast("int").alias("i"), (F.col("cell") % 40).alias("j"), "v.value", "v.active")
    return rounded(out, "value")


@query(f"WITH {_FUSED}, d AS (SELECT ts, value, abs(value - coalesce(lag(value) OVER (PARTITION BY i, j ORDER BY ts), 0)) AS d FROM fl) SELECT ts, {r('least(greatest(max(value), 0), 1)')} AS total_activity, {r('least(avg(d), 1)')} AS novelty, (SELECT {r('least(greatest(tanh(avg(activity)), 0), 1)')} FROM ev WHERE ev.ts = d.ts) AS env_drift FROM d GROUP BY ts")
def global_metrics(spark, sf):
    f = fusion.fuse(tables.default_links(spark), tables.grid(spark), evidence(spark, sf))
    drifts = evidence(spark, sf).select("ts", "link_id", F.col("activity").alias("drift_common"))
    return rounded(message.global_metrics(f, drifts), "total_activity", "novelty", "env_drift")


@query(f"WITH {_EVID} SELECT ts, CASE WHEN avg(health_score) >= 0.75 THEN 'NOMINAL' WHEN avg(health_score) >= 0.45 THEN 'DEGRADED' ELSE 'DISCONNECTED' END AS csi_health FROM ev GROUP BY ts")
def system_health(spark, sf):
    e = evidence(spark, sf)
    return message.system_health(e, e.select("ts").distinct())


# regions

_COMP = """a AS MATERIALIZED (SELECT i, j, value, i * 1000 + j AS id FROM g WHERE value > 2 * (SELECT avg(value) FROM g)), e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON {near}),
rc AS (SELECT id AS a, id AS b FROM a UNION SELECT rc.a, e.b FROM rc JOIN e ON rc.b = e.a), lb AS MATERIALIZED (SELECT a AS id, min(b) AS label FROM rc GROUP BY a)"""
_FOUR = "abs(x.i - y.i) + abs(x.j - y.j) = 1"
_EIGHT = "abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND x.id <> y.id"


def _threshold(g: DataFrame) -> float:
    return 2 * g.agg(F.avg("value")).first()[0]


def _regions_sql(near: str) -> str:
    return f"""WITH RECURSIVE {GRID}, {_COMP.format(near=near)} SELECT CAST(row_number() OVER (ORDER BY size DESC, label) AS INTEGER) AS rank, size, total_intensity, {r('cr')} AS centroid_row, {r('cc')} AS centroid_col, row_min, row_max, col_min, col_max
FROM (SELECT label, count(*) AS size, sum(value) AS total_intensity, sum(i * value) / sum(value) AS cr, sum(j * value) / sum(value) AS cc, min(i) AS row_min, max(i) AS row_max, min(j) AS col_min, max(j) AS col_max FROM a JOIN lb ON a.id = lb.id GROUP BY label)"""


@query(_regions_sql(_FOUR))
def regions_4(spark, sf):
    g = tables.grid2d(spark, sf)
    return rounded(cluster.find_regions(g, _threshold(g), 1, 4), "centroid_row", "centroid_col")


@query(_regions_sql(_EIGHT))
def regions_8(spark, sf):
    g = tables.grid2d(spark, sf)
    return rounded(cluster.find_regions(g, _threshold(g), 1, 8), "centroid_row", "centroid_col")


@query(f"WITH RECURSIVE {GRID}, {_COMP.format(near=_FOUR)} SELECT count(DISTINCT label) AS n FROM lb")
def count_regions(spark, sf):
    g = tables.grid2d(spark, sf)
    return cluster.count_regions(g, _threshold(g))


_PER_TICK = f"""{_FUSED}, {_HOLD}, pa AS MATERIALIZED (SELECT ts, i, j, f AS value, i * 1000 + j AS id FROM st WHERE rn > 0 AND act AND f > 0.05),
pe AS MATERIALIZED (SELECT x.ts, x.id AS a, y.id AS b FROM (SELECT ts, id, unnest([id - 1000, id - 1, id + 1, id + 1000]) AS n FROM pa) x JOIN pa y ON x.ts = y.ts AND x.n = y.id),
pr AS (SELECT ts, id, id AS label FROM pa UNION SELECT pe.ts, pe.b, pr.label FROM pr JOIN pe ON pe.ts = pr.ts AND pe.a = pr.id WHERE pr.label < pe.b),
pl AS (SELECT ts, id, min(label) AS label FROM pr GROUP BY ts, id),
pg AS MATERIALIZED (SELECT pa.ts, label, count(*) AS size, sum(value) AS total_intensity, sum(i * value) / sum(value) AS centroid_row, sum(j * value) / sum(value) AS centroid_col FROM pa JOIN pl ON pa.ts = pl.ts AND pa.id = pl.id GROUP BY pa.ts, label HAVING count(*) >= 4)"""


@query(
    f"""WITH RECURSIVE {_PER_TICK} SELECT ts, CAST(row_number() OVER (PARTITION BY ts ORDER BY size DESC, label) AS INTEGER) AS rank, size, {r('total_intensity')} AS total_intensity, {r('centroid_row')} AS centroid_row, {r('centroid_col')} AS centroid_col FROM pg"""
)
def regions_per_tick(spark, sf):
    f = fusion.persist(fusion.fuse(tables.default_links(spark), tables.grid(spark), evidence(spark, sf)))
    return rounded(cluster.find_regions_per_tick(f, 0.05, 4), "centroid_row", "centroid_col", "total_intensity")


# series: recurrences on events

_SERIES = "s AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS link_id, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


@query(
    f"""WITH RECURSIVE {_SERIES}, e AS (SELECT link_id, seq, rn, CAST(0.1 AS DOUBLE) * value AS ema, CASE WHEN CAST(0.1 AS DOUBLE) * value >= 40 THEN 1 ELSE 0 END AS n FROM s WHERE rn = 1
UNION ALL SELECT link_id, seq, rn, ema, CASE WHEN ema >= 40 THEN n + 1 ELSE 0 END FROM (SELECT s.link_id, s.seq, s.rn, CAST(0.9 AS DOUBLE) * e.ema + CAST(0.1 AS DOUBLE) * s.value AS ema, e.n FROM e JOIN s ON s.link_id = e.link_id AND s.rn = e.rn + 1))
SELECT link_id, seq, {r('ema')} AS ema, CAST(n AS INTEGER) AS above FROM e"""
)
def exponential_average(spark, sf):
    """The average, and how many rows in a row it has been at 40 or more: two linear recurrences, scanned."""
    rows = tables.series(spark, sf).select("link_id", "seq", "value")
    ema = scan_linear(rows, ["link_id"], ["seq"], F.lit(0.9), 0.1 * F.col("value"), F.lit(0.0), "ema")
    high = (F.col("ema") >= 40).cast("double")
    out = scan_linear(ema, ["link_id"], ["seq"], high, high, F.lit(0.0), "above")
    return rounded(out.select("link_id", "seq", "ema", F.col("above").cast("int").alias("above")), "ema")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS link_id, event_id AS seq, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS DOUBLE) AS fps FROM events"
)
def frame_rate(spark, sf):
    """Events of the last hour, by the operator for ticks of the last second."""
    e = tables.series(spark, sf).select("link_id", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("wall_us"))
    return message.frame_rate(e.withColumnRenamed("link_id", "room"), span_us=3_600_000_000).select(F.col("room").alias("link_id"), "seq", "fps")


@query("SELECT CAST(user_id AS VARCHAR) AS link_id, max(value) AS peak, arg_max(event_id, value * 1e6 - event_id * 1e-3) AS at FROM events GROUP BY user_id")
def peak_with_tie_rule(spark, sf):
    e = tables.series(spark, sf)
    return e.groupBy("link_id").agg(F.max("value").alias("peak"), F.max_by("seq", F.struct("value", -F.col("seq"))).alias("at"))


# tracking and messages


def _tracked(spark, sf) -> DataFrame:
    found = QUERIES["regions_per_tick"](spark, sf)
    rows = found.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("rank", "centroid_row", "centroid_col", "size", "total_intensity"))).alias("clusters"))
    c = ServerConfig()
    return tracking.track_rooms(rows.withColumn("room", F.lit("room")), (c.field_resolution, c.field_resolution), (c.room_x_min, c.room_y_min))


@query(
    f"""WITH RECURSIVE {_PER_TICK}, cd AS (SELECT ts, round(-5 + 0.25 * ({r('centroid_row')}), 5) AS x, round(-5 + 0.25 * ({r('centroid_col')}), 5) AS y, round(greatest(0.3, least(2.0, sqrt(size) * 0.125)), 5) AS radius, round(least(1.0, ({r('total_intensity')}) / greatest(size, 1)), 5) AS activity FROM pg)
SELECT ts, x + 0.0 AS x, y + 0.0 AS y, radius, activity, true AS sound FROM cd"""
)
def track_positions(spark, sf):
    """Where the tracker's entities are: every region of a tick is exactly one entity of that tick."""
    e = _tracked(spark, sf).select("ts", F.col("entities.id").alias("ids"), F.explode("entities").alias("e"))
    sound = (F.size(F.array_distinct("ids")) == F.size("ids")) & F.col("e.stability").between(0, 1) & (F.col("e.frames_tracked") >= 1) & (F.col("e.last_change") <= F.col("ts"))
    return e.select("ts", *[half_away(F.col(f"e.{n}"), 5).alias(n) for n in ("x", "y", "radius", "activity")], sound.alias("sound"))


_ENTITY = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, activity DOUBLE, stability DOUBLE, last_change DOUBLE, radius DOUBLE, frames_tracked BIGINT)"
_MATCHING = f"STRUCT(e {_ENTITY}, kept {_ENTITY}[], used BIGINT[])"
#: Entities in their order take the nearest free candidate of the tick, one after the other; what is left is new.
_GREEDY = f"""list_reduce(list_concat([CAST({{'e': NULL, 'kept': [], 'used': []}} AS {_MATCHING})], list_transform(es, lambda e: CAST({{'e': e, 'kept': [], 'used': []}} AS {_MATCHING}))),
lambda m, it: list_transform([list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_contains(m.used, i) THEN 'inf'::DOUBLE ELSE sqrt(power(it.e.x - c[i].x, 2) + power(it.e.y - c[i].y, 2)) END)],
lambda ds: CASE WHEN list_min(ds) < 1.5 THEN CAST({{'e': it.e, 'used': list_append(m.used, list_position(ds, list_min(ds))), 'kept': list_append(m.kept, list_transform([c[list_position(ds, list_min(ds))]], lambda b:
CAST({{'id': it.e.id, 'x': b.x, 'y': b.y, 'activity': b.activity, 'stability': 0.7::DOUBLE * greatest(0, 1 - list_min(ds) * 0.5::DOUBLE) + 0.3::DOUBLE * it.e.stability,
'last_change': CASE WHEN list_min(ds) > 0.3 OR abs(b.activity - it.e.activity) > 0.2 THEN ts ELSE it.e.last_change END, 'radius': b.radius, 'frames_tracked': it.e.frames_tracked + 1}} AS {_ENTITY}))[1])}} AS {_MATCHING}) ELSE m END)[1])"""


@query(
    f"""WITH RECURSIVE {_PER_TICK}, cd AS (SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY size DESC, label) AS rk, -5 + 0.25::DOUBLE * ({r('centroid_row')}) AS x, -5 + 0.25::DOUBLE * ({r('centroid_col')}) AS y,
greatest(0.3::DOUBLE, least(2.0::DOUBLE, sqrt(size) * 0.125::DOUBLE)) AS radius, least(1.0::DOUBLE, ({r('total_intensity')}) / greatest(size, 1)) AS activity FROM pg),
tk AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, list({{'x': x, 'y': y, 'radius': radius, 'activity': activity}} ORDER BY rk) AS c FROM cd GROUP BY ts),
tr AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS ts, CAST(1 AS BIGINT) AS next_id, CAST([] AS {_ENTITY}[]) AS es UNION ALL
SELECT rn, ts, next_id + len(fresh), list_concat(m.kept, list_transform(fresh, lambda i, k: CAST({{'id': next_id + k - 1, 'x': c[i].x, 'y': c[i].y, 'activity': c[i].activity, 'stability': 0.5, 'last_change': ts, 'radius': c[i].radius, 'frames_tracked': 1}} AS {_ENTITY})))
FROM (SELECT *, list_filter(range(1, len(c) + 1), lambda i: NOT list_contains(m.used, i)) AS fresh FROM (SELECT rn, ts, next_id, c, {_GREEDY} AS m FROM (SELECT tk.rn, tk.ts, tr.next_id, tk.c, tr.es FROM tr JOIN tk ON tk.rn = tr.rn + 1))))
SELECT ts, e.id AS id, {r('e.x')} AS x, {r('e.y')} AS y, 0.0::DOUBLE AS z, {r('e.activity')} AS activity, {r('e.stability')} AS stability, e.last_change AS last_change, {r('e.radius')} AS radius, e.frames_tracked AS frames_tracked
FROM (SELECT ts, unnest(es) AS e FROM tr WHERE rn > 0)"""
)
def track_entities(spark, sf):
    """Ids, ages and matches of the tracker, tick by tick."""
    e = _tracked(spark, sf).select("ts", F.explode("entities").alias("e")).select("ts", "e.*")
    return e.withColumns({n: half_away(F.col(n), 6) for n in ("x", "y", "activity", "stability", "radius")})


@query(f"WITH d AS (SELECT event_id, value AS x, value / 2 AS y, value / 3 AS z FROM events) SELECT event_id, {r('sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4))')} AS d2, {r('sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4) + (z - 5) * (z - 5))')} AS d3, {r('x + 0.5 * 2')} AS px, {r('y - 0.5 * 2')} AS py FROM d")
def detections_and_tracks(spark, sf):
    """Distances of detections, and tracks carried on at constant velocity."""
    d = tables.read(spark, sf, "events").select("event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y"), (F.col("value") / 3).alias("z"))
    d2 = tracking.distance(F.col("x"), F.col("y"), F.lit(3.0), F.lit(4.0))
    d3 = tracking.distance(F.col("x"), F.col("y"), F.lit(3.0), F.lit(4.0), F.col("z"), F.lit(5.0))
    moved = tracking.predict(d.select("event_id", d2.alias("d2"), d3.alias("d3"), "x", "y", F.struct(F.lit(0.5).alias("vx"), F.lit(-0.5).alias("vy")).alias("velocity")), 2.0)
    return rounded(moved.select("event_id", "d2", "d3", F.col("x").alias("px"), F.col("y").alias("py")), "d2", "d3", "px", "py")


@query()
def state_messages(spark, sf):
    """The whole tick: synthetic frames, sensing, fusion, regions, tracking, metrics, document."""
    from fieldlark.plans.pipeline import room_messages

    return room_messages(spark, ticks=12)


_DOC = "struct<timestamp:double,entities:array<struct<id:bigint,x:double>>,global:struct<total_activity:double,novelty:double,env_drift:double>,system:struct<fps:double,sensor_count:int,csi_health:string>,field:struct<width:int,height:int,data:array<double>,confidence_data:array<double>,min_value:double,max_value:double>,intermediate:struct<cluster_count:int,clusters:array<struct<size:bigint>>,links:map<string,struct<health:struct<health_score:double,status:string>>>>>"


@query("SELECT round(n * 0.05::DOUBLE, 6) AS ts, 40 AS width, 40 AS height, true AS field_is_whole, true AS limits_hold, 3 AS sensors, true AS health_agrees, true AS metrics_in_range, true AS an_entity_per_cluster FROM (SELECT unnest(range(1, 13)) AS n)")
def state_messages_are_sound(spark, sf):
    """The documents read back: what the parts of a message say of each other."""
    d = F.from_json("message", _DOC)
    m = QUERIES["state_messages"](spark, sf).select("ts", d.alias("d")).select("ts", "d.*")
    data, cells = F.col("field.data"), F.col("field.width") * F.col("field.height")
    scores = F.transform(F.map_values("intermediate.links"), lambda x: x["health"]["health_score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    status = F.when(mean >= 0.75, "NOMINAL").when(mean >= 0.45, "DEGRADED").otherwise("DISCONNECTED")
    ranges = F.lit(True)
    for name in ("total_activity", "novelty", "env_drift"):
        ranges = ranges & F.col(f"global.{name}").between(0, 1)
    return m.select(
        F.round("ts", 6).alias("ts"), "field.width", "field.height",
        ((F.size(data) == cells) & (F.size("field.confidence_data") == cells) & (F.col("timestamp") == F.col("ts"))).alias("field_is_whole"),
        ((F.array_min(data) == F.col("field.min_value")) & (F.array_max(data) == F.col("field.max_value")) & (F.round(F.array_max(data), 9) == F.round("global.total_activity", 9))).alias("limits_hold"),
        F.size("intermediate.links").alias("sensors"), (status == F.col("system.csi_health")).alias("health_agrees"), ranges.alias("metrics_in_range"),
        ((F.size("entities") == F.col("intermediate.cluster_count")) & (F.size("intermediate.clusters") == F.col("intermediate.cluster_count"))).alias("an_entity_per_cluster"),
    )


# the whole pipeline over given frames, as a batch and as a stream

_ROOM_FRAMES = """f AS MATERIALIZED (SELECT 'link_' || CAST(vec_id % 3 AS VARCHAR) AS link_id, (vec_id // 3 + 1) * 0.05::DOUBLE AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
l AS MATERIALIZED (SELECT link_id, ts, CAST(k AS INTEGER) AS k, a[k + 1] + 1 AS amp, a[k + 1] * 4 AS phase FROM (SELECT link_id, ts, a, unnest(range(len(a))) AS k FROM f))"""
_ROOM_EVID = "ev AS MATERIALIZED (SELECT rw.ts, rw.link_id, tanh(20 * value) AS activity, score AS health_score, least(greatest(score * (1 - 0.5 * ro), 0), 1) AS confidence, drift_common, value FROM rw JOIN me ON rw.link_id = me.link_id AND rw.rn = me.rn JOIN h ON rw.link_id = h.link_id AND rw.ts = h.ts)"
_ROOM_TICKS = f"{_ROOM_FRAMES}, {SENSED}, " + _PER_TICK.replace(_EVID, _ROOM_EVID).replace("f AS value", "f * confidence AS value").replace("f > 0.05", "f * confidence > 0.05")
_TICK_SQL = f"""WITH RECURSIVE {_ROOM_TICKS}, sw AS (SELECT ts, i, j, CASE WHEN act THEN f ELSE 0 END AS value, CASE WHEN act THEN confidence ELSE 0 END AS confidence FROM st WHERE rn > 0),
nv AS (SELECT *, abs(value - coalesce(lag(value) OVER (PARTITION BY i, j ORDER BY ts), 0)) AS d FROM sw),
fd AS (SELECT ts, max(value) AS top, avg(d) AS novelty, sum(value) AS total, sum(confidence) AS sure FROM nv GROUP BY ts),
el AS (SELECT ts, avg(health_score) AS health, tanh(avg(drift_common)) AS env, sum(value) AS measured, count(*) AS n FROM ev GROUP BY ts),
cl AS (SELECT ts, count(*) AS n, sum(total_intensity) AS intensity, max(size) AS largest FROM pg GROUP BY ts)
SELECT round(fd.ts, 6) AS ts, 3 AS sensors, CAST(el.n AS INTEGER) AS links, {r('least(top, 1)')} AS total_activity, {r('least(novelty, 1)')} AS novelty, {r('least(env, 1)')} AS env_drift,
CASE WHEN health >= 0.75 THEN 'NOMINAL' WHEN health >= 0.45 THEN 'DEGRADED' ELSE 'DISCONNECTED' END AS csi_health, round(total, 5) + 0.0 AS field_sum, round(sure, 3) + 0.0 AS confidence_sum, {r('top')} AS field_max, {r('measured')} AS measured,
CAST(coalesce(cl.n, 0) AS INTEGER) AS cluster_count, CAST(coalesce(cl.n, 0) AS INTEGER) AS entities, round(coalesce(intensity, 0), 3) + 0.0 AS intensity, coalesce(largest, 0) AS largest
FROM fd JOIN el ON fd.ts = el.ts LEFT JOIN cl ON fd.ts = cl.ts"""
_ROOM_DOC = "struct<timestamp:double,entities:array<struct<id:bigint>>,global:struct<total_activity:double,novelty:double,env_drift:double>,system:struct<sensor_count:int,csi_health:string>,field:struct<data:array<double>,confidence_data:array<double>,max_value:double>,intermediate:struct<cluster_count:int,clusters:array<struct<size:bigint,total_intensity:double>>,links:map<string,struct<measurement:struct<value:double>>>>>"


def _read_documents(messages: DataFrame) -> DataFrame:
    """What the state messages of a room say, field by field."""
    m = messages.select(F.from_json("message", _ROOM_DOC).alias("d")).select("d.*")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    of = lambda name: F.transform("intermediate.clusters", lambda c: c[name])
    return m.select(
        F.round("timestamp", 6).alias("ts"), F.col("system.sensor_count").alias("sensors"), F.size("intermediate.links").alias("links"), *[F.round(f"global.{n}", 6).alias(n) for n in ("total_activity", "novelty", "env_drift")],
        F.col("system.csi_health").alias("csi_health"), F.round(total("field.data"), 5).alias("field_sum"), F.round(total("field.confidence_data"), 3).alias("confidence_sum"), F.round("field.max_value", 6).alias("field_max"),
        F.round(total(F.transform(F.map_values("intermediate.links"), lambda x: x["measurement"]["value"])), 6).alias("measured"),
        F.col("intermediate.cluster_count").alias("cluster_count"), F.size("entities").alias("entities"), F.round(total(of("total_intensity")), 3).alias("intensity"), F.coalesce(F.array_max(of("size")), F.lit(0)).alias("largest"),
    )


@query(_TICK_SQL)
def room_ticks(spark, sf):
    """State messages of the frames in embeddings, by the batch plan."""
    from fieldlark.plans.pipeline import rooms_messages

    return _read_documents(rooms_messages(tables.room_frames(spark, sf)))


@query(_TICK_SQL)
def room_ticks_streamed(spark, sf):
    """The same messages by the stream: keyed state of links and rooms, ticks closed by timers."""
    from fieldlark.streaming import room

    links = tables.default_links(spark)
    return _read_documents(room.replayed(tables.room_frames(spark, sf), lambda arriving: room.message_stream(arriving, links), arrivals=2))


@query(
    f"WITH RECURSIVE {_ROOM_FRAMES}, {SENSED}, {_ROOM_EVID} SELECT link_id, round(ts, 6) AS ts, {r('activity')} AS activity, {r('health_score')} AS health_score, {r('confidence')} AS confidence, {r('drift_common')} AS drift_common FROM ev"
)
def link_evidence_streamed(spark, sf):
    """Evidence of every frame in embeddings, from the keyed state of its link."""
    from fieldlark.streaming import room

    out = room.replayed(tables.room_frames(spark, sf), room.link_stream, arrivals=3)
    return rounded(out.select("link_id", "ts", "activity", "health_score", "confidence", "drift_common"), "ts", "activity", "health_score", "confidence", "drift_common")
