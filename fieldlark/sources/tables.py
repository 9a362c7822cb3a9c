"""Tables of the driver seen as sensing data, and the dimension tables of the room."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark import config as C


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, ts, amplitude, phase) from embeddings: label is the link, vec_id the time."""
    amplitude = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("link_id"), F.col("vec_id").cast("double").alias("ts"), amplitude.alias("amplitude"), F.transform(amplitude, lambda x: x * 40.0).alias("phase")
    )


def room_frames(spark: SparkSession, sf_dir: str, rooms: int = 1, dt: float = C.ServerConfig().dt) -> DataFrame:
    """(room, link_id, ts, amplitude, phase) from embeddings: vec_id counts rooms, then the three links, then ticks.

    Amplitudes are around 1, as those of a link without disturbance are.
    """
    n = F.col("vec_id")
    tick = F.floor(n / (3 * rooms)) + 1
    x = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("room_"), (n % rooms).cast("string")).alias("room"), F.concat(F.lit("link_"), (F.floor(n / rooms) % 3).cast("string")).alias("link_id"),
        (tick * dt).alias("ts"), F.transform(x, lambda v: v + 1.0).alias("amplitude"), F.transform(x, lambda v: v * 4.0).alias("phase"),
    )


def long(frames: DataFrame) -> DataFrame:
    """(link_id, ts, k, amp, phase): a row per subcarrier, with the block of its frame, if it has one."""
    both, block = F.arrays_zip("amplitude", "phase"), [c for c in ("_pos", "_block", "_halo") if c in frames.columns]
    return frames.select("link_id", "ts", *block, F.posexplode(both).alias("k", "v")).select("link_id", "ts", *block, "k", F.col("v.amplitude").alias("amp"), F.col("v.phase").alias("phase"))


def pack(rows: DataFrame, *values: str) -> DataFrame:
    """The inverse of ``long``: arrays in order of k."""
    g = rows.groupBy("link_id", "ts").agg(F.array_sort(F.collect_list(F.struct("k", *values))).alias("v"))
    return g.select("link_id", "ts", *[F.col(f"v.{n}").alias(n) for n in values])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, ts seconds, seq, value) from events."""
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("link_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type", "value")


def grid2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse (i, j, value): customers counted by balance and nation."""
    i = F.floor((F.col("c_acctbal") + 1000.0) / 275.0).cast("int")
    return read(spark, sf_dir, "customer").groupBy(i.alias("i"), F.col("c_nationkey").cast("int").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse (i, j, k, value): line items counted by quantity, discount and tax."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_quantity").cast("int").alias("i"), F.rint(F.col("l_discount") * 100).cast("int").alias("j"), F.rint(F.col("l_tax") * 100).cast("int").alias("k"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def default_links(spark: SparkSession, c: C.ServerConfig = C.ServerConfig()) -> DataFrame:
    """A horizontal, a vertical and a diagonal link, set in from the walls."""
    lo_x, hi_x, lo_y, hi_y, d, z = c.room_x_min, c.room_x_max, c.room_y_min, c.room_y_max, c.link_inset, c.link_z
    mid_x, mid_y = (lo_x + hi_x) / 2, (lo_y + hi_y) / 2
    rows = [
        ("link_0", (lo_x + d, mid_y, z), (hi_x - d, mid_y, z), c.frequency_hz),
        ("link_1", (mid_x, lo_y + d, z), (mid_x, hi_y - d, z), c.frequency_hz),
        ("link_2", (lo_x + d, lo_y + d, z), (hi_x - d, hi_y - d, z), c.frequency_hz),
    ]
    return spark.createDataFrame(rows, C.LINK_GEOMETRY)


def default_objects(spark: SparkSession) -> DataFrame:
    """A moving, a static and an oscillating disturbance."""
    rows = [
        ("walker", "moving", 0.0, -3.0, 1.5, 0.3, 1.4, 1.1, 1.5, 0.0, 0.0, -4.0, 4.0, -3.5, 3.5),
        ("person", "static", 1.0, 1.0, 1.0, 0.0, 0.0, 0.8, 1.0, 0.0, 0.0, -4.0, 4.0, -4.0, 4.0),
        ("fan", "oscillating", -2.0, 2.0, 1.2, 0.0, 0.0, 0.7, 0.8, 0.4, 0.5, -4.0, 4.0, -4.0, 4.0),
    ]
    return spark.createDataFrame(rows, C.DISTURBANCE)


def grid(spark: SparkSession, c: C.ServerConfig = C.ServerConfig()) -> DataFrame:
    """(i, j, x, y) of every cell of the floor, x and y at cell centres."""
    nx, ny = c.width, c.height
    n = spark.range(nx * ny)
    i, j = F.floor(F.col("id") / ny).cast("int"), (F.col("id") % ny).cast("int")
    return n.select(i.alias("i"), j.alias("j"), (c.room_x_min + (i + 0.5) * c.field_resolution).alias("x"), (c.room_y_min + (j + 0.5) * c.field_resolution).alias("y"))


def voxel_grid(spark: SparkSession, dims: tuple[float, float, float], origin: tuple[float, float, float], resolution: float) -> DataFrame:
    """(i, j, k, x, y, z) of every voxel; each axis has ceil(size / resolution) voxels, 1 at least."""
    import math

    nx, ny, nz = (max(1, math.ceil(d / resolution)) for d in dims)
    n = spark.range(nx * ny * nz)
    i, j, k = F.floor(F.col("id") / (ny * nz)).cast("int"), (F.floor(F.col("id") / nz) % ny).cast("int"), (F.col("id") % nz).cast("int")
    at = [(o + (a + 0.5) * resolution).alias(name) for name, o, a in zip("xyz", origin, (i, j, k))]
    return n.select(i.alias("i"), j.alias("j"), k.alias("k"), *at)


def as_frame(df: DataFrame, link_id: str = "default", source: str | None = None) -> DataFrame:
    """Legacy (timestamp, amplitude, phase) or synthetic (timestamp, amplitudes, phases) rows as frames."""
    for plural, name in (("amplitudes", "amplitude"), ("phases", "phase"), ("timestamp", "ts")):
        if plural in df.columns and name not in df.columns:
            df = df.withColumnRenamed(plural, name)
    if "link_id" not in df.columns:
        df = df.withColumn("link_id", F.lit("synthetic" if source == "synthetic" else link_id))
    if "meta" not in df.columns:
        df = df.withColumn("meta", F.create_map(F.lit("source"), F.lit(source)) if source else F.expr("cast(map() as map<string,string>)"))
    return df.select("link_id", "ts", "amplitude", "phase", "meta")


def to_legacy(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").alias("timestamp"), "amplitude", "phase")


def from_raw(frames: DataFrame, amplitude, phase, method: str) -> DataFrame:
    """Conditioned frames that keep the raw arrays beside the new ones."""
    return frames.select("link_id", "ts", amplitude.alias("amplitude"), phase.alias("phase"), F.col("amplitude").alias("amplitude_raw"), F.col("phase").alias("phase_raw"), F.lit(method).alias("conditioning_method"), "meta")
