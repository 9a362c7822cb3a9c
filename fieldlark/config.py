"""Constants of the sensing pipeline and the schemas of its tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

_D, _S, _I, _A = T.DoubleType(), T.StringType(), T.IntegerType(), T.ArrayType(T.DoubleType(), False)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


POINT = _struct(x=_D, y=_D, z=_D)
QUALITY = _struct(snr=_D, confidence=_D, completeness=_D, stability=_D, outlier_score=_D)
FRAME = _struct(link_id=_S, ts=_D, amplitude=_A, phase=_A, meta=T.MapType(_S, _S))
CONDITIONED_FRAME = _struct(link_id=_S, ts=_D, amplitude=_A, phase=_A, amplitude_raw=_A, phase_raw=_A, conditioning_method=_S, meta=T.MapType(_S, _D))
#: A measurement is a scalar or a vector: exactly one of value and vector is set.
MEASUREMENT = _struct(link_id=_S, ts=_D, value=_D, vector=_A, unit=_S, quality=QUALITY, meta=T.MapType(_S, _D))
LINK_HEALTH = _struct(link_id=_S, snr_db=_D, amplitude_std=_D, phase_std=_D, outlier_ratio=_D, health_score=_D, status=_S)
LINK_GEOMETRY = _struct(link_id=_S, tx=POINT, rx=POINT, frequency_hz=_D)
LINK_EVIDENCE = _struct(ts=_D, link_id=_S, activity=_D, health_score=_D, confidence=_D)
FIELD_METADATA = _struct(ts=_D, source=_S, frame_count=T.LongType(), link_ids=T.ArrayType(_S), extra=T.MapType(_S, _S))
FIELD_2D = _struct(ts=_D, i=_I, j=_I, value=_D, confidence=_D)
FIELD_3D = _struct(ts=_D, i=_I, j=_I, k=_I, value=_D, confidence=_D)
FUSION_OUTPUT = _struct(ts=_D, activity=T.ArrayType(FIELD_2D), link_weights=T.MapType(_S, _D), active_links=T.ArrayType(_S))
SPATIAL_CLUSTER = _struct(centroid_row=_D, centroid_col=_D, size=T.LongType(), total_intensity=_D, row_min=_I, row_max=_I, col_min=_I, col_max=_I, pixels=T.ArrayType(_struct(r=_I, c=_I)))
LATENT_CLUSTER = _struct(cluster_id=_I, center=_A, size=T.LongType(), indices=T.ArrayType(T.LongType()))
DETECTION_2D = _struct(x=_D, y=_D, ts=_D, confidence=_D, intensity=_D, size=_D, bbox=T.ArrayType(_D), meta=T.MapType(_S, _S))
DETECTION_3D = _struct(x=_D, y=_D, z=_D, ts=_D, confidence=_D, intensity=_D, size=_D, bbox=T.ArrayType(_D), meta=T.MapType(_S, _S))
TRACK_STATES = ("TENTATIVE", "CONFIRMED", "COASTING", "DELETED")
TRACK_2D = _struct(track_id=T.LongType(), x=_D, y=_D, ts=_D, state=_S, velocity=_struct(vx=_D, vy=_D), age=_I, hits=_I, time_since_update=_I, history=T.ArrayType(_struct(t=_D, x=_D, y=_D)))
TRACK_3D = _struct(track_id=T.LongType(), x=_D, y=_D, z=_D, ts=_D, state=_S, velocity=_struct(vx=_D, vy=_D, vz=_D), age=_I, hits=_I, time_since_update=_I, history=T.ArrayType(_struct(t=_D, x=_D, y=_D, z=_D)))
ENTITY = _struct(id=T.LongType(), x=_D, y=_D, z=_D, activity=_D, stability=_D, last_change=_D, radius=_D, frames_tracked=T.LongType())
DISTURBANCE = _struct(object_id=_S, kind=_S, x=_D, y=_D, z=_D, vx=_D, vy=_D, radius=_D, intensity=_D, amplitude=_D, frequency=_D, x_min=_D, x_max=_D, y_min=_D, y_max=_D)

SPEED_OF_LIGHT = 299_792_458.0


@dataclass(frozen=True)
class ServerConfig:
    """Run-time constants of the live pipeline (fixed values)."""

    host: str = "0.0.0.0"
    port: int = 5000
    ws_path: str = "/ws"
    target_fps: float = 8.0
    dt: float = 0.05
    room_x_min: float = -5.0
    room_x_max: float = 5.0
    room_y_min: float = -5.0
    room_y_max: float = 5.0
    room_z_min: float = 0.0
    room_z_max: float = 3.0
    field_resolution: float = 0.25
    num_subcarriers: int = 64
    link_inset: float = 0.5
    link_z: float = 1.5
    frequency_hz: float = 5.8e9
    bandwidth_hz: float = 40e6
    amplitude_noise: float = 0.01
    phase_noise: float = 0.05
    clip_z: float = 3.5
    drift_alpha: float = 0.03
    measurement_alpha: float = 0.05
    window_size: int = 10
    decay: float = 0.90
    enter_threshold: float = 0.12
    exit_threshold: float = 0.08
    persistence: int = 3
    min_activity: float = 0.01
    min_health: float = 0.35
    log_fusion_weight: float = 0.75
    sharpening: float = 0.35
    cluster_threshold: float = 0.05
    cluster_min_size: int = 4
    match_threshold: float = 1.5
    stability_scale: float = 0.5

    @property
    def width(self) -> int:
        """Cells along x, 1 at least."""
        return max(1, math.ceil((self.room_x_max - self.room_x_min) / self.field_resolution))

    @property
    def height(self) -> int:
        """Cells along y, 1 at least."""
        return max(1, math.ceil((self.room_y_max - self.room_y_min) / self.field_resolution))

    def __post_init__(self):
        if not 0 <= self.exit_threshold <= self.enter_threshold <= 1:
            raise ValueError("thresholds must satisfy 0 <= exit <= enter <= 1")
        for name in ("target_fps", "dt", "field_resolution"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("drift_alpha", "measurement_alpha"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if not 0 <= self.decay < 1 or self.persistence < 1 or self.window_size < 2:
            raise ValueError("decay in [0, 1), persistence >= 1 and window_size >= 2 are required")
