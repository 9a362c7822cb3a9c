"""The whole sensing pipeline as one batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.config import ServerConfig
from fieldlark.operators import cluster, fusion, message, sensing, synthetic, tracking, world
from fieldlark.operators.lineage import Rounds
from fieldlark.sources import tables


def room_frames(spark: SparkSession, ticks: int, c: ServerConfig = ServerConfig(), seed: int = 42, noise: bool = True) -> DataFrame:
    """(link_id, ts, amplitude, phase) of the default links over the default scene."""
    links, objects = tables.default_links(spark, c), world.at_ticks(tables.default_objects(spark), ticks, c.dt)
    rows = synthetic.generate(
        links, world.path_disturbance(links, objects), c.dt, n=c.num_subcarriers, fc=c.frequency_hz, bw=c.bandwidth_hz,
        sigma_amp=c.amplitude_noise if noise else 0.0, sigma_phase=c.phase_noise if noise else 0.0, seed=seed,
    )
    packed = tables.pack(rows, "amp", "phase")
    return packed.select("link_id", "ts", F.col("amp").alias("amplitude"), "phase")


def _paced(every: DataFrame, walls: DataFrame | None, c: ServerConfig) -> DataFrame:
    if walls is None:
        return every.select(*ROOM_TICK, F.lit(c.target_fps).alias("fps"), F.lit(0.0).alias("latency_ms"))
    walls = walls if "room" in walls.columns else walls.withColumn("room", F.lit("room"))
    rate = message.frame_rate(walls).select(*ROOM_TICK, "fps", "latency_ms")
    return every.join(rate, list(ROOM_TICK), "left").select(*ROOM_TICK, F.coalesce("fps", F.lit(0.0)).alias("fps"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))


ROOM_TICK = ("room", "ts")


def rooms_messages(frames: DataFrame, c: ServerConfig = ServerConfig(), walls: DataFrame | None = None) -> DataFrame:
    """(room, ts, message): frames (room, link_id, ts, amplitude, phase) of many rooms, all with
    the default links, to state messages.

    Every stage is keyed by room: links, cells and the trackers of all rooms run in
    parallel.  ``walls``: (room, ts, wall_us, latency_ms), when each tick was taken and how
    long that took; the rate is that of the second before.  Without it ticks have the rate
    aimed at.
    """
    spark, by = frames.sparkSession, ROOM_TICK
    links, cells = tables.default_links(spark, c), tables.grid(spark, c)
    cut = Rounds(spark).cut  # what several parts of the message read is written once
    sensed = cut(sensing.sense_links(frames, ("room", "link_id"), clip_z=c.clip_z, drift_alpha=c.drift_alpha, window=c.window_size))
    evidence = sensing.evidence_from(sensed, by)
    field = cut(fusion.persist(fusion.fuse(links, cells, evidence, c, by=by), c, ("room", "i", "j")))
    active = fusion.link_weights(fusion.gate(links, evidence, c, by), by)
    found = cluster.find_regions_per_tick(field.withColumn("value", F.col("value") * F.col("confidence")), c.cluster_threshold, c.cluster_min_size, by=by)
    shown = F.struct("centroid_row", "centroid_col", "size", "total_intensity")
    every = evidence.select(*by).distinct()
    ranked = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("c")))), lambda x: x["c"]).alias("clusters"))
    none = F.expr("cast(array() as array<struct<centroid_row:double,centroid_col:double,size:bigint,total_intensity:double>>)")
    clusters = cut(every.join(ranked, list(by), "left").withColumn("clusters", F.coalesce("clusters", none)))
    step = c.field_resolution
    entities = tracking.track_rooms(clusters, (step, step), (c.room_x_min, c.room_y_min), c.match_threshold, c.stability_scale)
    entities = entities.select(*by, F.transform("entities", lambda e: e.dropFields("frames_tracked")).alias("entities"))
    drifts = sensed.select(*by, "link_id", F.col("drift")["drift_common"].alias("drift_common"))
    return message.state_messages(
        _paced(every, walls, c),
        message.global_metrics(field, drifts, by),
        message.system_health(sensed, every, by),
        message.field_documents(field, active, c, by),
        clusters,
        entities,
        message.link_documents(links, sensed, by),
        sensors=links.count(),
        by=by,
    )


def room_messages(spark: SparkSession, ticks: int, c: ServerConfig = ServerConfig(), frames: DataFrame | None = None, walls: DataFrame | None = None) -> DataFrame:
    """(ts, message): frames of one room, or made ones, to state messages."""
    frames = room_frames(spark, ticks, c) if frames is None else frames
    return rooms_messages(frames.withColumn("room", F.lit("room")), c, walls).drop("room")
