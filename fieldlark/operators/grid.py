"""Fields and voxel volumes in long form: sampling, projections, slices, boundaries, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = {"sum": F.sum, "max": F.max, "mean": F.avg}
KEEP = {"z": ("i", "j"), "y": ("i", "k"), "x": ("j", "k")}


def cell_center(index: Column, origin: float, resolution: float) -> Column:
    return origin + (index + 0.5) * resolution


def world_to_cell(at: Column, origin: float, resolution: float, n: int) -> Column:
    """Index along one axis, truncated toward zero; null outside."""
    i = ((at - origin) / resolution).cast("int")
    return F.when((i >= 0) & (i < n), i)


def value_at(points: DataFrame, field: DataFrame, origin: tuple[float, ...], resolution: float, shape: tuple[int, ...]) -> DataFrame:
    """Points with the value of their cell, null outside the grid."""
    names = "ijk"[: len(shape)]
    for a, name, o, n in zip("xyz", names, origin, shape):
        points = points.withColumn(name, world_to_cell(F.col(a), o, resolution, n))
    return points.join(field.select(*names, "value"), list(names), "left")


def set_values(field: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """The field with the cells of ``updates`` replaced."""
    keys = [k for k in keys if k in field.columns]
    new = updates.select(*keys, F.col("value").alias("_new"))
    return field.join(new, keys, "full").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def densify(field: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """All cells of the grid, 0 where the sparse field has none; needed before mean, min and median."""
    spark = field.sparkSession
    names, n = "ijk"[: len(shape)], 1
    for s in shape:
        n *= s
    cells, step = spark.range(n), n
    for name, s in zip(names, shape):
        step //= s
        cells = cells.withColumn(name, (F.floor(F.col("id") / step) % s).cast("int"))
    return cells.drop("id").join(field, list(names), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def stats(field: DataFrame) -> DataFrame:
    return field.agg(F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.sum("value").alias("total_value"))


def project(volume: DataFrame, axis: str = "z", method: str = "sum") -> DataFrame:
    """Collapse an axis of a dense volume."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return volume.groupBy(*KEEP[axis]).agg(METHODS[method]("value").alias("value"))


def floor_projection(volume: DataFrame, method: str = "sum") -> DataFrame:
    return project(volume, "z", method)


def vertical_projection_xz(volume: DataFrame, method: str = "max") -> DataFrame:
    return project(volume, "y", method)


def vertical_projection_yz(volume: DataFrame, method: str = "max") -> DataFrame:
    return project(volume, "x", method)


def all_projections(volume: DataFrame, method: str = "max") -> DataFrame:
    """(plane, a, b, value) of the three projections from one scan, by grouping sets."""
    view = volume.select("i", "j", "k", "value")
    rows = view.groupingSets([[F.col("i"), F.col("j")], [F.col("i"), F.col("k")], [F.col("j"), F.col("k")]], F.col("i"), F.col("j"), F.col("k"))
    out = rows.agg(METHODS[method]("value").alias("value"), F.grouping("i").alias("gi"), F.grouping("j").alias("gj"), F.grouping("k").alias("gk"))
    plane = F.when(F.col("gk") == 1, "xy").when(F.col("gj") == 1, "xz").otherwise("yz")
    return out.select(plane.alias("plane"), F.when(F.col("gi") == 1, F.col("j")).otherwise(F.col("i")).alias("a"), F.when(F.col("gk") == 1, F.col("j")).otherwise(F.col("k")).alias("b"), "value")


def project_floor(volume: DataFrame, method: str = "max") -> DataFrame:
    """Floor projection with confidence: that of the highest voxel (the lowest k on a tie) for
    ``max``, the mean otherwise."""
    c = F.max_by("confidence", F.struct("value", -F.col("k"))) if method == "max" else F.avg("confidence")
    return volume.groupBy("i", "j").agg(METHODS[method]("value").alias("value"), c.alias("confidence"))


def orthographic(volume: DataFrame, threshold: float) -> DataFrame:
    """The three maximum projections with values up to the threshold taken as 0."""
    return all_projections(volume.withColumn("value", F.when(F.col("value") > threshold, F.col("value")).otherwise(F.lit(0.0))), "max")


def slice_at(volume: DataFrame, axis: str, index: int, n: int) -> DataFrame:
    """The plane ``index`` of an axis (k for z, i for x, j for y)."""
    if not 0 <= index < n:
        raise IndexError(f"index {index} is out of range for {n}")
    return volume.where(F.col({"z": "k", "x": "i", "y": "j"}[axis]) == index).select(*KEEP[axis], "value")


def slice_indices(n: int, n_slices: int) -> list[int]:
    """Evenly spaced planes from the first to the last."""
    return [0] if n_slices == 1 else [int(s * (n - 1) / (n_slices - 1)) for s in range(n_slices)]


def sampled_slices(volume: DataFrame, n: int, n_slices: int) -> DataFrame:
    return volume.where(F.col("k").isin(slice_indices(n, n_slices))).select("k", "i", "j", "value")


def boundary(volume: DataFrame, level: float) -> DataFrame:
    """Voxels above ``level`` with one of their six neighbours not above it; the edge counts as outside."""
    inside = volume.where(F.col("value") > level).select("i", "j", "k")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    reached = inside.select(F.explode(steps).alias("s"), "i", "j", "k").select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), (F.col("k") + F.col("s.c")).alias("k"))
    touched = reached.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))
    return inside.join(touched, ["i", "j", "k"], "left").where(F.coalesce("n", F.lit(0)) < 6).select("i", "j", "k")


def above(field: DataFrame, level: float) -> DataFrame:
    return field.where(F.col("value") > level)


def subsample(field: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones every time; a report limit."""
    keys = [c for c in ("i", "j", "k") if c in field.columns]
    return field.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def decay(field: DataFrame, factor: float) -> DataFrame:
    return field.withColumn("value", F.col("value") * factor)


def clear(field: DataFrame) -> DataFrame:
    return field.withColumn("value", F.lit(0.0))


def accumulate(field: DataFrame, sampled: DataFrame, weight: float = 1.0) -> DataFrame:
    """Old value plus weight times the sample."""
    keys = [c for c in ("i", "j", "k") if c in field.columns]
    return field.join(sampled.select(*keys, F.col("value").alias("_s")), keys, "left").withColumn("value", F.col("value") + weight * F.coalesce("_s", F.lit(0.0))).drop("_s")


def limits(*fields: DataFrame) -> DataFrame:
    """Shared colour limits of several fields."""
    out = fields[0].select("value")
    for f in fields[1:]:
        out = out.unionByName(f.select("value"))
    return out.agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
