"""Disturbances in the room: their motion, and the field they make at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.predicates import require_objects
from fieldlark.operators.fold import fold_columns

#: Objects are broadcast, each point looking at all of them, up to so many rows; beyond, points and objects meet by grid bin.
BROADCAST_OBJECTS = 500


def add_objects(objects: DataFrame, more: DataFrame) -> DataFrame:
    """The world with ``more`` disturbances; rows that are none are refused."""
    return objects.unionByName(require_objects(more))


def remove_object(objects: DataFrame, object_id: str) -> DataFrame:
    return objects.where(F.col("object_id") != object_id)


def at_ticks(objects: DataFrame, ticks: int, dt: float, record_from: int = 1, start: int = 0, with_velocity: bool = False) -> DataFrame:
    """(object_id, tick, t, x, y, z, radius, intensity[, vx, vy]) after each of ``ticks`` steps from tick ``start`` on.

    Moving objects step, and where they leave their bounds the velocity flips and the
    position is clamped; objects run in parallel, a row per tick streams through the step.
    Oscillating ones pulse in closed form, from a clock of their own that starts at 0.
    """
    if dt < 0:
        raise ValueError("dt must not be negative")

    def bounce(p: float, v: float, lo: float, hi: float) -> tuple[float, float]:
        q = p + v * dt
        return (hi, -v) if q > hi else (lo, -v) if q < lo else (q, v)

    def step(state, kind, x, y, vx, vy, x_min, x_max, y_min, y_max):
        if state is None:
            state = x, y, vx, vy
        elif kind == "moving":
            (x, vx), (y, vy) = bounce(state[0], state[2], x_min, x_max), bounce(state[1], state[3], y_min, y_max)
            state = x, y, vx, vy
        return state, state

    given = ["z", "radius", "intensity", "amplitude", "frequency"]
    rows = objects.select("*", F.explode(F.sequence(F.lit(start), F.lit(start + ticks))).alias("tick"))
    moved = fold_columns(rows.withColumn("given", F.struct("kind", *given)), ["object_id"], ["tick", "given"], ["kind", "x", "y", "vx", "vy", "x_min", "x_max", "y_min", "y_max"], step, "x double, y double, vx double, vy double")
    moved = moved.where(F.col("tick") >= start + record_from).select("object_id", "tick", "x", "y", "vx", "vy", "given.*")
    t = F.col("tick") * F.lit(dt)
    pulse = F.greatest(F.lit(0.0), F.col("intensity") + F.col("amplitude") * F.sin(2 * 3.141592653589793 * F.col("frequency") * t))
    return moved.select("object_id", "tick", t.alias("t"), "x", "y", "z", "radius", F.when(F.col("kind") == "oscillating", pulse).otherwise(F.col("intensity")).alias("intensity"), *(["vx", "vy"] if with_velocity else []))


def _gaussian(d2: Column) -> Column:
    return F.col("intensity") * F.exp(-d2 / (2 * F.col("radius") * F.col("radius")))


def field_at(points: DataFrame, objects: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    """Sum over objects of gaussians at points (x, y, z), 0 beyond three radii; ``keys`` name a point.

    ``points`` and ``objects`` may share a ``tick``.  A small object table is broadcast
    behind a count; a large one meets the points by bins of three radii, an equi-join.
    """
    timed = "tick" in points.columns and "tick" in objects.columns
    keep = ["object_id", "radius", "intensity", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz")] + ([F.col("tick").alias("otick")] if timed else [])
    o = objects.select(*keep)
    d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2
    near = d2 <= 9 * F.col("radius") * F.col("radius")
    if timed:
        near = near & (F.col("tick") == F.col("otick"))
    if few is None:
        few = o.limit(BROADCAST_OBJECTS + 1).count() <= BROADCAST_OBJECTS
    if few:
        met = points.join(F.broadcast(o), near, "left")
    else:
        size = 3 * (o.agg(F.max("radius")).first()[0] or 1.0)
        cell = lambda c: F.floor(F.col(c) / size)
        around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        spread = o.withColumn("n", F.explode(around)).select("*", (cell("ox") + F.col("n.a")).alias("bx"), (cell("oy") + F.col("n.b")).alias("by"))
        placed = points.withColumn("px", cell("x")).withColumn("py", cell("y"))
        met = placed.join(spread, (F.col("px") == F.col("bx")) & (F.col("py") == F.col("by")) & near, "left")
    return met.groupBy(*keys).agg(F.coalesce(F.sum(_gaussian(d2)), F.lit(0.0)).alias("value"))


def path_points(links: DataFrame, n: int = 10) -> DataFrame:
    """n points along each link at t = 0.1 .. 0.9."""
    s = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")
    rows = links.select("link_id", "tx", "rx", s)
    t = F.lit(0.1) + F.col("s") * ((0.9 - 0.1) / max(n - 1, 1))
    at = [(F.col(f"tx.{a}") + t * (F.col(f"rx.{a}") - F.col(f"tx.{a}"))).alias(a) for a in "xyz"]
    return rows.select("link_id", "s", *at)


def path_disturbance(links: DataFrame, objects: DataFrame, n: int = 10) -> DataFrame:
    """(link_id[, tick], disturbance): the mean field along each link."""
    points = path_points(links, n)
    keys = ["link_id", "s"]
    if "tick" in objects.columns:
        points = points.crossJoin(F.broadcast(objects.select("tick").distinct()))
        keys.append("tick")
    sampled = field_at(points, objects, keys)
    return sampled.groupBy(*[k for k in keys if k != "s"]).agg(F.avg("value").alias("disturbance"))
