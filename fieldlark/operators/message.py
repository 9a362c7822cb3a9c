"""The state message of a tick, its parts, and the metrics in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.config import SPEED_OF_LIGHT, ServerConfig
from fieldlark.functions.arrays import clip, health_status
from fieldlark.operators.fold import dealt


TICK = ("ts",)


def field_change(field: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, novelty, peak): mean absolute change of the field since the tick before, which was 0 before the first, and its maximum."""
    cell = [b for b in by if b != "ts"] + ["i", "j"]
    before = F.lag("value", 1, 0.0).over(Window.partitionBy(*cell).orderBy("ts"))
    return dealt(field, *cell).withColumn("d", F.abs(F.col("value") - before)).groupBy(*by).agg(clip(F.avg("d"), 0, 1).alias("novelty"), F.max("value").alias("peak"))


def global_metrics(field: DataFrame, drifts: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, total_activity, novelty, env_drift) from the field and (by, link_id, drift_common), in one pass over the field."""
    env = drifts.groupBy(*by).agg(clip(F.tanh(F.avg("drift_common")), 0, 1).alias("env_drift"))
    moved = field_change(field, by).select(*by, clip(F.col("peak"), 0, 1).alias("total_activity"), "novelty")
    return moved.join(env, list(by), "left").withColumn("env_drift", F.coalesce("env_drift", F.lit(0.0)))


def system_health(health: DataFrame, ticks: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, csi_health) from the mean health of links; DISCONNECTED without any."""
    h = health.groupBy(*by).agg(F.avg("health_score").alias("h"))
    return ticks.join(h, list(by), "left").select(*by, F.coalesce(health_status(F.col("h")), F.lit("DISCONNECTED")).alias("csi_health"))


def frame_rate(ticks: DataFrame, wall_us: str = "wall_us", span_us: int = 1_000_000) -> DataFrame:
    """Ticks in the second up to each tick, by its wall clock in microseconds; rooms in parallel."""
    w = Window.partitionBy("room").orderBy(F.col(wall_us)).rangeBetween(-span_us, 0)
    return ticks.withColumn("fps", F.count(F.lit(1)).over(w).cast("double"))


def _point(c: str) -> Column:
    return F.array(F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z"))


def link_documents(links: DataFrame, sensed: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, links): map of link to geometry, health, measurement and drift."""
    rows = with_geometry(sensed, links).select(*by, "link_id", link_document().alias("doc"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("link_id", "doc")))).alias("links"))


def with_geometry(sensed: DataFrame, links: DataFrame) -> DataFrame:
    """Sensed rows of known links, with their geometry; links are the dimension table of a room."""
    geometry = F.struct(_point("tx").alias("tx_xyz"), _point("rx").alias("rx_xyz"), "frequency_hz", (F.lit(SPEED_OF_LIGHT) / F.col("frequency_hz")).alias("wavelength_m"))
    return sensed.join(F.broadcast(links.select("link_id", geometry.alias("geometry"))), "link_id")


def link_document() -> Column:
    """The JSON document of a sensed row with its geometry."""
    health = F.struct("link_id", "snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score", "status")
    measurement = F.struct("value", F.col("quality.confidence").alias("confidence"), F.col("quality.snr").alias("snr_db"), F.col("measure_meta").alias("meta"))
    return F.to_json(F.struct("geometry", health.alias("health"), measurement.alias("measurement"), "drift"))


def _field(width: Column, height: Column, low: Column, high: Column, data: Column, confidence: Column, active: Column, c: ServerConfig) -> Column:
    return F.struct(
        F.lit("floor").alias("type"), width.alias("width"), height.alias("height"), F.lit(c.field_resolution).alias("resolution_m"), F.struct(F.lit(c.room_x_min).alias("x"), F.lit(c.room_y_min).alias("y")).alias("origin"),
        F.lit("geometry_fusion").alias("projection"), low.alias("min_value"), high.alias("max_value"), data.alias("data"), confidence.alias("confidence_data"),
        F.coalesce(active, F.expr("cast(array() as array<string>)")).alias("active_links"),
    )


def field_documents(field: DataFrame, active: DataFrame, c: ServerConfig = ServerConfig(), by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, field): the grid flattened row by row, with limits, confidence and active links."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "value", "confidence")))
    g = field.groupBy(*by).agg(cells.alias("c"), F.min("value").alias("low"), F.max("value").alias("high"), (F.max("i") + 1).alias("width"), (F.max("j") + 1).alias("height"))
    g = g.join(active.select(*by, "active_links"), list(by), "left")
    doc = _field(F.col("width"), F.col("height"), F.col("low"), F.col("high"), F.transform("c", lambda x: x["value"]), F.transform("c", lambda x: x["confidence"]), F.col("active_links"), c)
    return g.select(*by, doc.alias("field"))


def packed_field(c: ServerConfig = ServerConfig()) -> Column:
    """The document of a field that is held as arrays ``data`` and ``confidence``."""
    return _field(F.lit(c.width), F.lit(c.height), F.array_min("data"), F.array_max("data"), F.col("data"), F.col("confidence"), F.col("active_links"), c)


def empty_field(c: ServerConfig = ServerConfig()) -> Column:
    """The field of a tick before the first fusion."""
    none = F.expr("cast(array() as array<double>)")
    return F.struct(F.lit("floor").alias("type"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(c.field_resolution).alias("resolution_m"), F.struct(F.lit(c.room_x_min).alias("x"), F.lit(c.room_y_min).alias("y")).alias("origin"), F.lit("geometry_fusion").alias("projection"), F.lit(0.0).alias("min_value"), F.lit(0.0).alias("max_value"), none.alias("data"), none.alias("confidence_data"))


def state_messages(ticks: DataFrame, metrics: DataFrame, health: DataFrame, fields: DataFrame, clusters: DataFrame, entities: DataFrame, links: DataFrame, sensors: int, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, message): one JSON document per tick.

    ``ticks``: (ts, fps, latency_ms); ``clusters``: (ts, clusters); ``entities``: (ts, entities);
    ``links``: (ts, links as map of JSON texts).
    """
    rows = ticks
    for part in (metrics, health, fields, clusters, entities, links):
        rows = rows.join(part, list(by), "left")
    return with_documents(rows, sensors).select(*by, "message")


def _quoted(text: Column) -> Column:
    """A text as a JSON string, escaped."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def with_documents(rows: DataFrame, sensors: int) -> DataFrame:
    """Rows with all parts of a tick, with its document as ``message``."""
    documents = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    head = F.to_json(
        F.struct(
            F.col("ts").alias("timestamp"), "entities", F.struct("total_activity", "novelty", "env_drift").alias("global"),
            F.struct("fps", "latency_ms", F.lit(sensors).alias("sensor_count"), "csi_health").alias("system"), "field",
            F.struct(F.coalesce(F.size("clusters"), F.lit(0)).alias("cluster_count"), "clusters").alias("intermediate"),
        )
    )
    # the documents of links are JSON already: they close the last object by hand
    body = rows.withColumn("head", head)
    return body.withColumn("message", F.concat(F.substring("head", F.lit(1), F.length("head") - 2), F.lit(',"links":'), F.coalesce(documents, F.lit("{}")), F.lit("}}"))).drop("head")
